"""Inputs of the accuracy and paired evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv

CASE_SCHEMA = (
    "id string, file string, line int, language string, file_type string, category string,"
    " expected_detection boolean, original_value string, expected_output_line string, value_group string,"
    " expected_placeholder_category string, notes string, expected_sanitization boolean"
)
REQUIRED = ("id", "file", "language", "file_type", "category", "expected_detection")


def parse_cases(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON texts in ``value`` to (cases, rejects).

    Blank lines and ``#`` comments are skipped.  Invalid JSON, a missing required
    field and an id that occurs twice are rejected with their reason.
    """
    missing = "array_compact(array(" + ", ".join(f"if({f} is null, '{f}', null)" for f in REQUIRED) + "))"
    rows = (
        raw.selectExpr("trim(both from value) as value")
        .where("value <> '' and not startswith(value, '#')")
        .withColumn("c", F.from_json("value", CASE_SCHEMA + ", _corrupt_record string",
                                     {"columnNameOfCorruptRecord": "_corrupt_record"}))
        .select("value", "c.*")
        .withColumn("missing", F.expr(missing))
    )
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_same")).where("n_same > 1 and id is not null")
    checked = rows.join(repeated, "id", "left").withColumn(
        "reason",
        F.expr(
            "case when _corrupt_record is not null then 'invalid_json'"
            " when size(missing) > 0 then concat('missing_', array_join(missing, '_'))"
            " when n_same is not null then 'duplicate_id' end"
        ),
    )
    cases = checked.where("reason is null").selectExpr(
        "id", "file", "line", "language", "file_type", "category", "expected_detection", "original_value",
        "expected_output_line", "value_group", "expected_placeholder_category",
        "coalesce(notes, '') as notes", "coalesce(expected_sanitization, expected_detection) as expected_sanitization",
    )
    return cases, checked.where("reason is not null").select("id", "reason")


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_cases(spark.read.text(path))


SCORE_SCHEMA = (
    "language string, file string, task string, condition string, response_file string,"
    + ", ".join(f"{d} int" for d in fv.DIMENSIONS)
    + ", misunderstood_value int, relationships_preserved int, failure_modes string, notes string, deviation string"
)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores as CSV with a header; N/A reads as null, tags become an array."""
    rows = (
        spark.read.schema(SCORE_SCHEMA).option("header", "true").option("nullValue", "N/A")
        .option("mode", "FAILFAST").csv(path)
    )
    return rows.withColumn("tags", F.expr("filter(transform(split(failure_modes, ';'), t -> trim(t)), t -> t not in ('', 'none'))"))


def assert_counts(scores: DataFrame, n_rows: int, per_condition: int) -> DataFrame:
    """Stop if the number of rows, or of rows per condition, is not the expected
    one.  Returns the scores unchanged."""
    per = scores.groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    got = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    if got["rows"] != n_rows or any(n not in (None, per_condition) for n in (got["least"], got["most"])):
        raise ValueError(
            f"expected {n_rows} rows and {per_condition} per condition, got {got['rows']} and {got['least']} to {got['most']}"
        )
    return scores

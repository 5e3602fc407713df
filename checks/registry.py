"""Queries by name, each with the SQL that DuckDB runs for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.sources.corpus import explode_lines, from_table

from . import carriers

#: Tasks to deal small test tables to, which have one file each; 0 leaves tables as they
#: are read.  Only a run on a single machine sets it, see bench.py.
DEAL = 0

#: Rows of a given table that one task derives test input from and works on.  Millions of
#: rows fit one file of a few MB, which Spark reads in one task, while detectors take a
#: fraction of a millisecond for each.
ROWS_PER_TASK = 25_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition(DEAL) if DEAL else df


def carrier(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Rows derived from the given tables, which are dealt to tasks by their number before
    anything is derived from them."""
    if DEAL:
        return dealt(spark.sql(carriers.for_spark(sql, folder)))
    given, many = {}, False
    for name in set(carriers.tables(sql)):
        given[name] = table(spark, folder, name)
        tasks = -(-given[name].count() // ROWS_PER_TASK)
        if tasks > 1:
            given[name], many = given[name].repartition(tasks), True
    rows = spark.sql(sql, **given)
    return whole_rows(rows) if many else rows


def whole_rows(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator: what is done to them is planned once, not for each
    branch of a union, and what they are derived by is not done again."""
    return rows.selectExpr(f"inline(array(struct({', '.join(f'`{c}`' for c in rows.columns)})))")


def cfg_lines(spark: SparkSession, folder: str) -> DataFrame:
    return carrier(spark, folder, carriers.CFG_LINES)


def shape_lines(spark: SparkSession, folder: str) -> DataFrame:
    return carrier(spark, folder, carriers.SHAPE_LINES)


def code_lines(spark: SparkSession, folder: str) -> DataFrame:
    return carrier(spark, folder, carriers.CODE_LINES)


def as_files(texts: DataFrame) -> DataFrame:
    """(path, text) with the size and bytes that a scan looks at."""
    return from_table(texts, "path", "text")


def block_files(spark: SparkSession, folder: str) -> DataFrame:
    return as_files(carrier(spark, folder, carriers.BLOCK_FILES))


def line_files(spark: SparkSession, folder: str) -> DataFrame:
    return as_files(carrier(spark, folder, carriers.LINE_FILES))


def tree_files(spark: SparkSession, folder: str) -> DataFrame:
    """Line files and block files together."""
    return whole_rows(line_files(spark, folder).unionByName(block_files(spark, folder)))


def doc_files(spark: SparkSession, folder: str) -> DataFrame:
    return from_table(
        dealt(table(spark, folder, "documents")), "concat(source, '/', lang, '/doc_', cast(doc_id as string), '.txt')", "text"
    )


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    return from_table(dealt(table(spark, folder, "pages")), "concat('page_', cast(page_id as string), '.html')", "html")


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    return explode_lines(doc_files(spark, folder)).select("path", "line_no", "line")


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents and pages, and the lines that hold every value shape."""
    texts = doc_files(spark, folder).unionByName(page_files(spark, folder))
    return explode_lines(texts).select("path", "line_no", "line").unionByName(
        shape_lines(spark, folder).select("path", "line_no", "line")
    )


def plain_marks(column: str) -> str:
    """Text with the digits of token markers made equal."""
    return f"regexp_replace({column}, '_[0-9]{{40}}', '_N')"


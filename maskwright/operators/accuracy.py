"""How good are detection and sanitization, measured against labelled cases.

cases: see ``sources.evaluation``.  findings(file, line, key, rule, value, after).
"""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import Sql, q
from .occurrences import occurrences
from .paths import extension

MIN_LEAK_LENGTH = 8
MULTILINE_CATEGORY = "multiline_secret"


def label_outcomes(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Cases plus TP / FN / FP / TN by whether anything was found on their line."""
    found = findings.select("file", "line").distinct().withColumn("found", F.lit(True))
    outcome = (
        "case when expected_detection and found then 'TP' when expected_detection then 'FN'"
        " when found then 'FP' else 'TN' end"
    )
    return cases.join(found, ["file", "line"], "left").withColumn("outcome", F.expr(outcome)).drop("found")


def _metrics(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: f"try_divide({a}, {b})"
    precision, recall = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    return (
        counts.withColumns({"precision": F.expr(precision), "recall": F.expr(recall)})
        .withColumn("f1", F.expr("if(precision > 0 and recall > 0, 2 * precision * recall / (precision + recall), null)"))
        .withColumn("false_positive_rate", F.expr(ratio("fp", "fp + tn")))
    )


def _outcome_counts() -> list:
    return [F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(o.lower()) for o in ("TP", "FP", "FN", "TN")]


def prf(outcomes: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, F1, false-positive rate; null where a
    denominator is 0."""
    small = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return _metrics(small.groupBy().agg(*_outcome_counts()))


def prf_by(outcomes: DataFrame, columns: tuple[str, ...] = ("language", "file_type", "category")) -> DataFrame:
    """The same per value of each column, and for all: (dimension, value, ...)."""
    named = [F.expr(f"coalesce(nullif({c}, ''), '(unspecified)')").alias(c) for c in columns]
    small = outcomes.select(*named, "outcome").groupBy(*columns, "outcome").agg(F.count(F.lit(1)).alias("n"))
    sets = small.groupingSets([[F.col(c)] for c in columns] + [[]], *[F.col(c) for c in columns]).agg(
        *_outcome_counts(), F.sum("n").alias("case_count"), F.grouping_id().alias("gid")
    )
    # grouping_id has a 0 bit for the column that is grouped by
    width = len(columns)
    names = {(1 << width) - 1 - (1 << (width - 1 - i)): c for i, c in enumerate(columns)}
    dimension = "case gid " + " ".join(f"when {g} then '{c}'" for g, c in names.items()) + " else 'overall' end"
    value = "case gid " + " ".join(f"when {g} then {c}" for g, c in names.items()) + " else '(all)' end"
    return _metrics(
        sets.withColumns({"dimension": F.expr(dimension), "value": F.expr(value)}).drop("gid", *columns)
    )


def unexpected(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """Findings on lines that no case labels."""
    return findings.join(cases.select("file", "line").distinct(), ["file", "line"], "left_anti")


def _caught(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'TP'")


def _caught_with_values(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    # the different values of one line
    values = findings.groupBy("file", "line").agg(F.collect_set("value").alias("found_values"))
    return _caught(outcomes).join(values, ["file", "line"])


def span_check(outcomes: DataFrame, findings: DataFrame, sanitized: DataFrame) -> DataFrame:
    """For each caught case: is the output line the expected one or, where none is
    given, free of every value found on it?  ``sanitized(file, text)``.  Lines meet the
    cases by file and number, so a text with many cases is not gathered with them."""
    caught = _caught_with_values(outcomes, findings).join(sanitized.select("file").distinct(), "file", "left_semi")
    lines = sanitized.selectExpr("file", "posexplode_outer(split(text, '\\n', -1)) as (at, out_line)").selectExpr("file", "cast(at + 1 as int) as line", "out_line")
    return caught.join(lines, ["file", "line"], "left").withColumn("out_line", F.coalesce("out_line", F.lit(""))).withColumn("span_ok", F.expr(
        "if(expected_output_line is not null, out_line = expected_output_line, not exists(found_values, v -> contains(out_line, v)))"
    )).drop("found_values")


def leaks_mask(outcomes: DataFrame, findings: DataFrame, sanitized: DataFrame, min_length: int = MIN_LEAK_LENGTH) -> DataFrame:
    """Add ``span_ok`` and ``leaked``: the original value still occurs in the file.
    Values shorter than ``min_length`` are taken to occur by chance and do not count.  A
    case's own line does not count once it was verified against its expected text."""
    checked = span_check(outcomes, findings, sanitized)
    values = checked.where(f"length(original_value) >= {min_length}").selectExpr("file", "original_value as value")
    found = occurrences(values, sanitized.selectExpr("file", "0 as side", "text")).select(
        "file", F.col("value").alias("original_value"), "first_line", "other_line"
    )
    own = f"line between {{0}} and {{0}} + {tx.newline_count('original_value')}"
    elsewhere = f"not ({own.format('first_line')}) or not ({own.format('other_line')})"
    leaked = f"first_line is not null and (not (expected_output_line is not null and span_ok) or coalesce({elsewhere}, false))"
    joined = checked.join(found, ["file", "original_value"], "left").withColumn("leaked", F.expr(leaked))
    return joined.select(*checked.columns, "leaked")


def leaks_token(outcomes: DataFrame, findings: DataFrame, original: DataFrame, sanitized: DataFrame) -> DataFrame:
    """Findings on caught lines whose value occurs in the output as often as in
    the input.  Counts are compared, since a value may also be part of its key."""
    both = original.select("file").join(sanitized.select("file"), "file", "left_semi").distinct()
    rows = findings.where("value <> ''").join(_caught(outcomes).select("file", "line").distinct(), ["file", "line"], "left_semi")
    rows = rows.join(both, "file", "left_semi")
    texts = original.selectExpr("file", "0 as side", "text").unionByName(sanitized.selectExpr("file", "1 as side", "text"))
    counts = occurrences(rows.select("file", "value"), texts).groupBy("file", "value").agg(
        F.sum(F.expr("if(side = 0, n, 0)")).alias("n_before"), F.sum(F.expr("if(side = 1, n, 0)")).alias("n_after")
    )
    return (
        rows.join(counts, ["file", "value"], "left").select(*rows.columns, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
        .withColumn("leaked", F.expr("n_after >= n_before"))
    )


def _group_findings(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    cases = _caught(outcomes).where("value_group is not null and value_group <> ''")
    return cases.select("file", "line", "value_group", "category").join(
        findings.select("file", "line", "after"), ["file", "line"]
    )


def consistency(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """Per value group: number of different replacements; consistent if one."""
    rows = _group_findings(outcomes, findings).where(F.col("category") != MULTILINE_CATEGORY)
    return rows.groupBy("value_group").agg(F.count_distinct("after").alias("n_tokens")).withColumn(
        "consistent", F.col("n_tokens") <= 1
    )


def consistency_multiline(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """Per value group of multi-line values: exactly one fragment carries a token,
    the others are empty."""
    rows = _group_findings(outcomes, findings).where(F.col("category") == MULTILINE_CATEGORY)
    return rows.groupBy("value_group").agg(F.count_if(F.col("after") != "").alias("n_tokens")).withColumn(
        "consistent", F.col("n_tokens") == 1
    )


def distinctness(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """Tokens owned by more than one original value of a category."""
    cases = _caught(outcomes).where("expected_placeholder_category <> '' and original_value <> ''")
    owned = (
        cases.selectExpr("file", "line", "expected_placeholder_category as category", "original_value")
        .join(findings.select("file", "line", F.col("after").alias("token")), ["file", "line"])
        .where("token <> ''")
    )
    return (
        owned.groupBy("category", "token").agg(F.count_distinct("original_value").alias("n_values")).where("n_values > 1")
    )


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two runs do not have equally often, with the surplus on each
    side.  One exchange for both directions."""
    columns = a.columns
    rows = a.select(*columns).withColumn("side", F.lit(1)).unionByName(b.select(*columns).withColumn("side", F.lit(-1)))
    return (
        rows.groupBy(*columns).agg(F.sum("side").alias("surplus")).where("surplus <> 0")
        .withColumn("only_in", F.expr("if(surplus > 0, 'first', 'second')"))
        .withColumn("surplus", F.abs("surplus"))
    )


def mode_parity(masked: DataFrame, tokenized: DataFrame) -> DataFrame:
    """Places that only one of the two modes finds; empty if they agree."""
    places = ("file", "line", "rule")
    return run_diff(masked.select(*places), tokenized.select(*places))


# ---- format checks ---------------------------------------------------------

# --- fixed values: how the format of a file is checked ----------------------
JSON_EXTENSIONS = ("json",)
XML_EXTENSIONS = ("xml", "config")
BALANCE_EXTENSIONS = ("java", "js", "jsx", "ts", "tsx", "go", "cs")
_OPEN, _CLOSE, _QUOTES = "({[", ")}]", "'\"`"


def balanced(text: Sql) -> Sql:
    """Brackets close in order and no quote stays open.

    The fold runs over brackets, quotes and backslash pairs only.  Inside a string
    a pair is skipped; outside, its second character is read as usual.
    """
    marks = tx.extract_all(text, r"""(?s)\\.|[(){}\[\]'"`]""")

    def state(quote: Sql, stack: Sql, ok: Sql = "true") -> Sql:
        return f"named_struct('quote', {quote}, 'stack', {stack}, 'ok', {ok})"

    def outside(c: Sql) -> Sql:
        closer = tx.lookup(list(zip(_OPEN, _CLOSE)), c)
        return (
            f"case when contains({q(_QUOTES)}, {c}) then {state(c, 's.stack')}"
            f" when contains({q(_OPEN)}, {c}) then {state(q(''), f'concat({closer}, s.stack)')}"
            f" when not contains({q(_CLOSE)}, {c}) then s"
            f" when left(s.stack, 1) = {c} then {state(q(''), 'substring(s.stack, 2)')}"
            f" else {state(q(''), 's.stack', 'false')} end"
        )

    step = (
        f"case when not s.ok then s"
        f" when s.quote <> '' then if(t = s.quote, {state(q(''), 's.stack')}, s)"
        f" else {tx.let('right(t, 1)', outside)} end"
    )
    return (
        f"aggregate({marks}, {state(q(''), q(''))}, (s, t) -> {step},"
        " s -> s.ok and s.quote = '' and s.stack = '')"
    )


def parses(kind: Sql, text: Sql):
    """Whether a text is one whole JSON or XML document for Python's parsers, which take
    repeated keys and NaN, and any size."""

    @F.pandas_udf("boolean")
    def parsed(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        def one(kind, text):
            try:
                if kind == "json":
                    json.loads(text or "")
                elif kind == "xml":
                    ElementTree.fromstring(text or "")
                else:
                    return None
            except (ValueError, RecursionError, ElementTree.ParseError):
                return False
            return True

        return pd.Series([one(k, t) for k, t in zip(kinds, texts)], dtype=object)

    return parsed(F.expr(kind), F.expr(text))


def check_format(files: DataFrame) -> DataFrame:
    """``files(path, text)`` to (path, status): a real parse for JSON and XML, a
    balance test for brace languages, not applicable for the rest.  Only texts of the
    first two go to Python."""
    ext = extension("path")
    kind = f"case when {tx.one_of(ext, JSON_EXTENSIONS)} then 'json' when {tx.one_of(ext, XML_EXTENSIONS)} then 'xml' end"
    rows = files.select("path", "text", F.expr(ext).alias("ext"), F.expr(kind).alias("parser"))
    rows = rows.withColumn("good", parses("parser", "if(parser is null, null, text)"))
    return rows.selectExpr(
        "path",
        f"case when parser is not null then if(good, 'valid', 'invalid')"
        f" when {tx.one_of('ext', BALANCE_EXTENSIONS)} then if({balanced('text')}, 'heuristic_valid', 'heuristic_invalid')"
        " else 'not_applicable' end as status",
    )


def format_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


def fingerprint_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare ``files(path, hash, text_hash)`` with a frozen manifest of the same
    form; ``text_hash`` ignores line-end differences."""
    f, m = files.alias("f"), manifest.alias("m")
    status = (
        "case when m.path is null then 'new' when f.path is null then 'missing'"
        " when f.hash = m.hash then 'same' when f.text_hash = m.text_hash then 'same_but_line_ends'"
        " else 'changed' end"
    )
    return f.join(m, F.col("f.path") == F.col("m.path"), "full").selectExpr(
        "coalesce(f.path, m.path) as path", f"{status} as status"
    )


def dangling_labels(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Cases whose file is absent or has no such line; ``files(file, n_lines)``."""
    return (
        cases.join(files.select("file", "n_lines"), "file", "left")
        .withColumn("problem", F.expr(
            "case when n_lines is null then 'file_absent' when line < 1 or line > n_lines then 'line_out_of_range' end"
        ))
        .where("problem is not null").select("id", "file", "line", "problem")
    )

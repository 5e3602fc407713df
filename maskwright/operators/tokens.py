"""Typed placeholders: one token per (category, value), numbered by first use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.text import Sql
from ..session import materialize
from .paths import walk_key

# A marker's digits, plain or inside XML.
MARK = r"_(\d{40})(?=>|&gt;)"
# Tokens with more than one of so many uses are joined by broadcast; there can be at
# most as many of them, whatever the data, and no other token has more of the rows.
HOT_TOKENS = 2000


def categorize(findings: DataFrame, rule_categories: DataFrame) -> DataFrame:
    """Add the category of each finding's rule; unknown rules get the default.
    ``rule_categories(rule, category)`` has one row per rule."""
    known = rule_categories.select("rule", F.col("category").alias("known"))
    return findings.join(known, "rule", "left").withColumn(
        "category", F.coalesce("known", F.lit(fv.DEFAULT_CATEGORY))
    ).drop("known")


def token_uses(found: DataFrame, path: str = "path") -> DataFrame:
    """Findings to one row per use of a value, with the place that orders it.
    The value itself is replaced by its marker digits."""
    return (
        found.where("size(uses) > 0")
        .selectExpr(
            f"{path} as path", "line", "category",
            f"named_struct('walk', {walk_key(path)}, 'stage', stage, 'line', line, 'ord', ord) as place",
            "posexplode(uses) as (pos, value)",
        )
        .selectExpr(
            "path", "line", "category", f"{tx.identity_digits('category', 'value')} as mark",
            "named_struct('walk', place.walk, 'stage', place.stage, 'line', place.line, 'ord', place.ord, 'pos', pos) as place",
        )
    )


def number_tokens(uses: DataFrame, key: str = "mark") -> DataFrame:
    """(category, key, n, token, n_uses), n counting from 1 in order of first use.

    There are few categories, so numbering inside a category must not be one
    task: the distinct values are range-partitioned by (category, place), sorted
    inside each partition and counted through there.  A value's number is its place
    in the partition, shifted by the counts of the partitions before.
    """
    spark = uses.sparkSession
    first = uses.groupBy("category", key).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n_uses"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        first.repartitionByRange(width, "category", "first").sortWithinPartitions("category", "first").drop("first")
        .withColumn("row", F.monotonically_increasing_id()),  # partition, then place in it
        "tokens",
    ).withColumn("part", F.shiftright("row", 33))
    # at most `width` rows per category, so the table of offsets may be broadcast
    before = Window.partitionBy("category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("category", "part").agg(F.count(F.lit(1)).alias("n_here"), F.min("row").alias("least"))
        .select("category", "part", "least", F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("offset"))
    )
    return (
        ranged.join(F.broadcast(offsets), ["category", "part"])
        .withColumn("n", F.expr("offset + row - least + 1"))
        .select("category", key, "n", F.concat(F.lit("<"), "category", F.lit("_"), "n", F.lit(">")).alias("token"), "n_uses")
    )


def assign_tokens(uses: DataFrame, tokens: DataFrame, *keys: str) -> DataFrame:
    """Give each use its token.

    ``tokens`` carries ``n_uses``.  The few very frequent tokens are joined by
    broadcast, so a value that fills a third of the corpus moves no rows; the
    rest is an ordinary join whose largest group is small.
    """
    keys = keys or ("mark",)
    total = tokens.agg(F.sum("n_uses")).first()[0] or 0
    wanted = tokens.select(*keys, "n", "token", "n_uses")
    hot = wanted.where(F.col("n_uses") * HOT_TOKENS > F.lit(total)).drop("n_uses")
    cold = wanted.where(F.col("n_uses") * HOT_TOKENS <= F.lit(total)).drop("n_uses")
    by_hot = uses.join(F.broadcast(hot), list(keys), "left")
    rest = by_hot.where("n is null").drop("n", "token")
    return by_hot.where("n is not null").unionByName(rest.join(cold, list(keys), "left"))


def resolve_text(text: Sql, numbers: Sql) -> Sql:
    """Put token numbers (map mark -> n) in place of marker digits."""
    marks = tx.extract_all(text, MARK, 1)
    new = tx.each(marks, lambda m: f"concat('_', coalesce(cast({numbers}[{m}] as string), {m}))")
    return f"if({tx.like(text, MARK)}, {tx.splice_all(text, MARK, new)}, {text})"


def resolve(rows: DataFrame, key: str, columns: list[str], tokens: DataFrame, hits: str | None = None) -> DataFrame:
    """Replace markers by tokens in text columns, and in the values and replacements of
    an array of hits; ``key`` names a row.  Only marks and row keys are exchanged, one
    small map per row comes back, which serves all."""
    texts = list(columns)
    if hits:
        both = tx.each(hits, lambda h: f"concat_ws(' ', {h}.value, {h}.after)")
        texts.append(f"array_join({both}, ' ')")
    all_text = "concat_ws(' ', " + ", ".join(texts) + ")"
    marks = rows.selectExpr(key, f"explode(array_distinct({tx.extract_all(all_text, MARK, 1)})) as mark")
    numbers = (
        assign_tokens(marks, tokens).where("n is not null").groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("mark", "n"))).alias("numbers"))
    )
    joined = rows.join(numbers, key, "left")
    for column in columns:
        joined = joined.withColumn(column, F.expr(resolve_text(column, "numbers")))
    if hits:
        fields = ("line", "stage", "ord", "key", "rule", "category", "value", "after", "changed", "uses")

        def named(h: Sql) -> Sql:
            field = lambda f: resolve_text(f"{h}.{f}", "numbers") if f in ("value", "after") else f"{h}.{f}"
            return "named_struct(" + ", ".join(f"'{f}', {field(f)}" for f in fields) + ")"

        joined = joined.withColumn(hits, F.expr(tx.each(hits, named)))
    return joined.drop("numbers")


def token_usage(assigned: DataFrame) -> DataFrame:
    """Where each token occurs: uses, lines, files.  Counted per file first, so a
    frequent token is spread over its files."""
    per_line = assigned.groupBy("category", "token", "path", "line").agg(F.count(F.lit(1)).alias("n"))
    per_file = per_line.groupBy("category", "token", "path").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("lines")
    )
    return per_file.groupBy("category", "token").agg(
        F.sum("n").alias("n_uses"), F.sum("lines").alias("n_lines"), F.count(F.lit(1)).alias("n_files")
    )

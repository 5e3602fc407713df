"""URL filter by hashed host-suffix and path-prefix expressions.

A rule is a host and a path prefix; it fits its host and all hosts below it, where the
path starts with the rule's.  Every URL is expanded into the expressions that a rule for
it could have: each suffix of its host with each prefix of its path whose length occurs
in the rules.  Expressions and rules meet on the first 4 bytes of their SHA-256, full
digests confirm, and the longest rule wins (then the longer host, then block).

Nulls and URLs without ``://`` have an empty host and path and fit no rule.  Equal URLs
are judged once.  Without a rule the verdict is allow; an empty rule table allows all.
Rules with a null in any field are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8  # hexadecimal digits
BROADCAST_ROWS = 500_000


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """``rules(host, path, verdict)`` applied: (page_id, host, path, rule, verdict)."""
    known = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("rule"), F.char_length("host").alias("host_length"), "verdict",
    ).distinct().withColumn("rule_digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("rule_digest", 1, PREFIX))
    n_rules = known.count()
    # a handful of numbers, bounded by the longest path
    lengths = [r[0] for r in rules.where("path is not null").select(F.char_length("path")).distinct().collect()]
    urls = pages.select(F.col(id_column).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*(F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)))) if lengths else F.array().cast("array<string>")
    asked = (
        urls.select("host", "path").distinct()
        .select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
        .select("host", "path", "digest", "prefix")
    )
    best = F.struct(F.char_length("rule").alias("size"), "host_length", F.col("verdict").alias("verdict"), "rule")
    found = (
        asked.join(F.broadcast(known) if n_rules <= BROADCAST_ROWS else known, "prefix").where("digest = rule_digest")
        .groupBy("host", "path").agg(F.max(best).alias("best"))
    )
    return urls.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )

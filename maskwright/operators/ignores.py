"""The ignore list: findings a person has marked as harmless, by value hash.

``ignores(file, key, rule, value_hash)``; key and value_hash may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .hits import ignore_entry
from .paths import join_listed

TRIPLE = ("file", "key", "rule")


def one_per_place(ignores: DataFrame) -> DataFrame:
    """One entry per (file, key, rule): the latest if there are times, else the one
    with the largest hash."""
    time = [F.col("created_at")] if "created_at" in ignores.columns else []
    latest = F.max_by("value_hash", F.struct(*time, F.coalesce("value_hash", F.lit(""))))
    return ignores.groupBy(*TRIPLE).agg(latest.alias("value_hash"))


def per_file(ignores: DataFrame) -> DataFrame:
    """(path, ignores): the map of each listed file's ignores, by one exchange."""
    return (
        one_per_place(ignores.repartition("file"))
        .select(F.col("file").alias("path"), F.struct(F.expr(ignore_entry("rule", "key")).alias("entry"), F.col("value_hash").alias("hash")).alias("e"))
        .groupBy("path").agg(F.map_from_entries(F.collect_list("e")).alias("ignores"))
    )


def attach(files: DataFrame, ignores: DataFrame, how: str = "left") -> DataFrame:
    """Add to each file the map of its own ignores, for use inside a scan; with ``inner``
    only to files that have some, and others drop out."""
    return join_listed(files, per_file(ignores), how, "ignore-maps")


def apply_ignores(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """Drop findings whose value is the ignored one; keep and flag those whose
    ignore has another value hash or none."""
    listed = one_per_place(ignores).select(
        F.col("file").alias("i_file"), F.col("key").alias("i_key"), F.col("rule").alias("i_rule"),
        F.col("value_hash").alias("i_hash"), F.lit(True).alias("listed"),
    )
    same_place = (
        (F.col("file") == F.col("i_file")) & F.col("key").eqNullSafe(F.col("i_key")) & (F.col("rule") == F.col("i_rule"))
    )
    return (
        findings.join(listed, same_place, "left")
        .where(f"listed is null or i_hash is null or i_hash <> {tx.value_hash('value')}")
        .withColumn("changed", F.expr("listed is not null"))
        .drop("i_file", "i_key", "i_rule", "i_hash", "listed")
    )


def upsert_ignore(ignores: DataFrame, new: DataFrame) -> DataFrame:
    """Latest entry per (file, key, rule): a new one replaces hash and time."""
    latest = F.max_by(F.struct("value_hash", "created_at"), F.struct("created_at", F.coalesce("value_hash", F.lit(""))))
    return (
        ignores.unionByName(new).groupBy(*TRIPLE).agg(latest.alias("e"))
        .select(*TRIPLE, "e.value_hash", "e.created_at")
    )


def upsert_by_project(ignores: DataFrame, new: DataFrame) -> DataFrame:
    """The same for lists of many projects, whose entries also have an id."""
    place = ["project_id", *TRIPLE]
    latest = F.max_by(F.struct("id", "value_hash", "created_at"), F.struct("created_at", F.coalesce("value_hash", F.lit("")), "id"))
    return (
        ignores.unionByName(new).groupBy(*place).agg(latest.alias("e"))
        .select("project_id", "e.id", *TRIPLE, "e.value_hash", "e.created_at")
    )


def remove_ignore(ignores: DataFrame, ids: DataFrame) -> DataFrame:
    return ignores.join(ids, "id", "left_anti")


def lookup_hash(wanted: DataFrame, pending: DataFrame, applied: DataFrame, latest_scan: DataFrame) -> DataFrame:
    """Hash of the current value of each wanted (file, key, rule): from the pending
    preview if it is there, else from the latest applied scan, first match in
    order of ``pos``; null if neither has it."""
    newest = applied.join(latest_scan.select("scan_id"), "scan_id", "left_semi")
    rows = pending.select(*TRIPLE, "value", "pos", F.lit(0).alias("rank")).unionByName(
        newest.select(*TRIPLE, "value", "pos", F.lit(1).alias("rank"))
    )
    best = rows.groupBy(*TRIPLE).agg(F.min_by("value", F.struct("rank", "pos")).alias("value"))
    w, b = wanted.select(*TRIPLE).alias("w"), best.alias("b")
    same = (
        (F.col("w.file") == F.col("b.file")) & F.col("w.key").eqNullSafe(F.col("b.key")) & (F.col("w.rule") == F.col("b.rule"))
    )
    return w.join(b, same, "left").selectExpr("w.file", "w.key", "w.rule", f"{tx.value_hash('b.value')} as value_hash")


def newly_unredacted(without: DataFrame, with_ignores: DataFrame) -> DataFrame:
    """Places that are found without ignores but not with them, by one exchange."""
    rows = without.select(*TRIPLE, F.lit(False).alias("left")).unionByName(with_ignores.select(*TRIPLE, F.lit(True).alias("left")))
    return rows.groupBy(*TRIPLE).agg(F.max("left").alias("left")).where("not left").drop("left")


def state_fingerprint(*tables: DataFrame) -> DataFrame:
    """One row (n_rows, sum_hash, xor_hash) that identifies the rows of the tables
    whatever their order.  Sums over row hashes combine on the map side; no table
    is brought to one place."""
    hashed = []
    for number, table in enumerate(tables):
        row = "concat_ws('\\u0002', " + f"'{number}', " + ", ".join(
            f"coalesce(cast(`{c}` as string), '\\u0003')" for c in table.columns
        ) + ")"
        hashed.append(table.selectExpr(f"md5({row}) as h"))
    rows = reduce(DataFrame.unionByName, hashed)
    return rows.selectExpr(
        "cast(conv(substring(h, 1, 15), 16, 10) as bigint) as a",
        "cast(conv(substring(h, 16, 15), 16, 10) as bigint) as b",
    ).selectExpr(
        "count(1) as n_rows",
        "cast(coalesce(sum(cast(a as decimal(38,0))), 0) as string) as sum_hash",
        "coalesce(bit_xor(b), 0) as xor_hash",
    )


def is_stale(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row: does the state at preview differ from the state now?"""
    b, n = before.alias("b"), now.alias("n")
    same = (
        (F.col("b.n_rows") == F.col("n.n_rows")) & (F.col("b.sum_hash") == F.col("n.sum_hash"))
        & (F.col("b.xor_hash") == F.col("n.xor_hash"))
    )
    return b.join(n, same, "left").select(F.col("n.n_rows").isNull().alias("stale"))

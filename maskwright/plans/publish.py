"""Whole runs published at once, and the history of projects as stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import history
from ..operators import ignores as ign
from ..operators.hits import Context
from ..sources.store import Change, Store
from .project import scan_project

WRITTEN = "path string, length bigint, sha256 string, copied boolean"


def publish_project(spark: SparkSession, input_root: str, target: str, ctx: Context, keep: int = 2, **options) -> Store:
    """Scan a tree and publish the sanitized files (table ``files``, real files below
    ``tree``), the list of those files (``written``), ``findings``, ``coverage``, and in
    token mode ``tokens``, all in one change.  If any task fails for good, readers still
    see the run before, and nothing of this one is left.  ``keep`` runs are kept."""
    store = Store(spark, target)
    with store.change() as change:
        run = change.folder()
        # whatever the scan writes lies in the run's folder, so that it goes with it
        done = scan_project(spark, input_root, f"{run}/files", ctx, tree=f"{run}/tree", results=f"{run}/results", **options)
        change.put("files", f"{run}/files")
        change.put("tree", f"{run}/tree")
        for name in ("findings", "coverage", "written"):
            change.put(name, f"{run}/results/{name}")
        change.drop("tokens")
        if done.sanitized.tokens is not None:
            change.put("tokens", f"{run}/results/tokens")
    store.vacuum(keep)
    return store


class History:
    """Tables of scans, findings and ignores, stored in buckets of projects.

    A change rewrites the buckets that it touches and leaves all others where they are.
    """

    TABLES = {
        "scans": "project_id bigint, scan_id bigint, ts timestamp, total_redactions bigint",
        "findings": "project_id bigint, scan_id bigint, file string, line int, key string, rule string, changed boolean",
        "ignores": "project_id bigint, id bigint, file string, key string, rule string, value_hash string, created_at timestamp",
    }

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.store, self.buckets = spark, Store(spark, root), buckets

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.store.read(table, self.TABLES[table], version)

    def _bucketed(self, rows: DataFrame, table: str) -> DataFrame:
        names = [f.split()[0] for f in self.TABLES[table].split(", ")]
        return rows.select(*names, F.expr(f"pmod(xxhash64(project_id), {self.buckets})").alias("bucket"))

    def _write(self, change: Change, rows: DataFrame, table: str) -> dict[int, str]:
        folder = change.folder()
        self._bucketed(rows, table).write.partitionBy("bucket").parquet(folder)
        there = self.store._system().listStatus(self.store._path(folder))
        names = [str(s.getPath().getName()) for s in there]
        return {int(n.removeprefix("bucket=")): f"{folder}/{n}" for n in names if n.startswith("bucket=")}

    def append(self, change: Change, table: str, rows: DataFrame) -> None:
        """Add rows; nothing stored is read."""
        for bucket, folder in self._write(change, rows, table).items():
            change.put(f"{table}/{bucket}", folder, add=True)

    def rewrite(self, change: Change, table: str, projects: DataFrame | None, new: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of the buckets of ``projects(project_id)`` (default: of all)
        by what ``new`` makes of them."""
        touched = range(self.buckets)
        if projects is not None:  # at most as many rows as there are buckets
            touched = [r[0] for r in projects.selectExpr(f"pmod(xxhash64(project_id), {self.buckets})").distinct().collect()]
        names = [f"{table}/{b}" for b in touched]
        folders = [f"{self.store.root}/{f}" for n in names for f in change.tables.get(n, [])]
        schema = self.TABLES[table]
        old = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        written = self._write(change, new(old), table)
        for bucket, name in zip(touched, names):
            change.drop(name)
            if bucket in written:
                change.put(name, written[bucket])

    def record_scan(self, project_id: int, scan_id: int, scanned_at: str, findings: DataFrame) -> None:
        """Add a scan and its findings, without any value."""
        safe = history.safe_findings(findings).selectExpr(f"{project_id}L as project_id", f"{scan_id}L as scan_id", "*")
        header = safe.agg(F.count(F.lit(1)).alias("total_redactions")).selectExpr(
            f"{project_id}L as project_id", f"{scan_id}L as scan_id", f"timestamp '{scanned_at}' as ts", "total_redactions"
        )
        with self.store.change() as change:
            self.append(change, "scans", header)
            self.append(change, "findings", safe)

    def retain(self, k: int = fv.RETAINED_SCANS) -> None:
        """Keep the findings of the ``k`` most recent scans only; the list of scans stays."""
        kept = F.broadcast(history.retain_recent(self.read("scans"), k).select("project_id", "scan_id"))  # k rows
        with self.store.change() as change:
            self.rewrite(change, "findings", None, lambda old: old.join(kept, ["project_id", "scan_id"], "left_semi"))

    def upsert_ignores(self, new: DataFrame) -> None:
        """Insert ignores or replace the hash, id and time of those at the same place."""
        with self.store.change() as change:
            self.rewrite(change, "ignores", new.select("project_id"), lambda old: ign.upsert_by_project(old, new))

    def remove_ignores(self, ids: DataFrame) -> None:
        """Remove ignores by ``ids(project_id, id)``."""
        with self.store.change() as change:
            self.rewrite(change, "ignores", ids.select("project_id"), lambda old: old.join(ids, ["project_id", "id"], "left_anti"))

    def drop_project(self, project_id: int) -> None:
        """Remove a project from all tables, in one change."""
        one = self.spark.createDataFrame([(project_id,)], "project_id bigint")
        with self.store.change() as change:
            for table in self.TABLES:
                self.rewrite(change, table, one, lambda old: history.drop_project({"t": old}, project_id)["t"])

"""Scans of arriving documents, published batch by batch.

Each batch reads the ignore list anew and is one change of a store: its findings, and the
fingerprint of the list that it was scanned with.  The tables of a batch bear its number,
so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hits import Context, findings
from ..operators.ignores import state_fingerprint
from ..plans.staging import scan_with_ignores
from ..session import scratch
from ..sources.store import Store

FOUND = "path string, line int, key string, rule string, value_hash string, changed boolean, batch bigint"
STATES = "n_rows bigint, sum_hash string, xor_hash bigint, batch bigint"


def publish_batch(store: Store, ctx: Context, ignores: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls with the files of a batch."""

    def run(files: DataFrame, batch: int) -> None:
        if f"states/{batch}" in store.tables():
            return
        with scratch(store.spark), store.change() as change:
            listed = ignores()
            found, state = change.folder(), change.folder()
            scanned = findings(scan_with_ignores(files, listed, ctx), "path")
            scanned.selectExpr("path", "line", "key", "rule", "sha2(value, 256) as value_hash", "changed", f"{batch}L as batch").write.parquet(found)
            state_fingerprint(listed.select("file", "key", "rule", "value_hash")).withColumn("batch", F.lit(batch).cast("bigint")).write.parquet(state)
            change.put(f"findings/{batch}", found)
            change.put(f"states/{batch}", state)

    return run


def drain_published(files: DataFrame, store: Store, ctx: Context, ignores: Callable[[], DataFrame], checkpoint: str) -> None:
    """Process what is there, batch by batch, and stop.  With the same checkpoint the
    next call continues where this one ended."""
    stream = files.writeStream.foreachBatch(publish_batch(store, ctx, ignores)).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()

"""Checks of the incremental scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators.hits import findings
from maskwright.plans.scan import scan
from maskwright.session import materialize, new_folder
from maskwright.sources.corpus import from_table
from maskwright.sources.store import Store
from maskwright.streaming.incremental import drain, read_new, scan_stream, scan_stream_ignoring
from maskwright.streaming.published import FOUND, drain_published

from .detection import DOC_FOUND, DOC_TREE, MASKED, doc_tree
from .registry import query, table

_PATH = DOC_TREE.split(" as path, text")[0].removeprefix("select ")


def arriving(spark, folder):
    schema = table(spark, folder, "documents").schema
    # as a pattern, the name may be that of one file or of a folder of files
    return from_table(read_new(spark, f"{folder}/{{documents.parquet}}", schema), _PATH, "text")


@query("stream_scan", f"select path, line_no as line, rule, sha256(value) as value_hash from ({DOC_FOUND})")
def stream_scan(spark, folder):
    """Documents as a stream, drained; the same findings as a batch."""
    out = drain(scan_stream(arriving(spark, folder), MASKED).selectExpr("path", "line", "rule", "sha2(value, 256) as value_hash"), "stream")
    return spark.read.parquet(out)


@query(
    "stream_scan_ignoring",
    f"select path, line_no as line, rule from ({DOC_FOUND}) where strlen(path) % 2 = 1",
)
def stream_scan_ignoring(spark, folder):
    """With a static ignore list for half of the files."""
    found = findings(scan(doc_tree(spark, folder), MASKED), "path").where("octet_length(path) % 2 = 0")
    ignores = found.selectExpr("path as file", "key", "rule", "sha2(value, 256) as value_hash").distinct()
    ignores = materialize(ignores, "ignores")
    stream = scan_stream_ignoring(arriving(spark, folder), ignores, MASKED).select("path", "line", "rule")
    return spark.read.parquet(drain(stream, "stream-ignoring"))



_ID = "cast(regexp_extract({path}, 'doc_([0-9]+)', 1) as bigint)"


@query(
    "stream_published",
    f"""with found as (select path, line_no as line, rule, {_ID.format(path='path')} % 3 as batch, strlen(path) % 2 = 0 as even from ({DOC_FOUND}))
 select path, line, rule, batch, batch = 2 and even as changed from found where not (even and batch < 2)""",
)
def stream_published(spark, folder):
    """Documents in three batches under an ignore list that changes before the third: at
    first it names the values of half of the files, then other values for them."""
    found = findings(scan(doc_tree(spark, folder), MASKED), "path").where("octet_length(path) % 2 = 0")
    listed = materialize(found.selectExpr("path as file", "key", "rule", "sha2(value, 256) as value_hash").distinct(), "ignores")
    docs = table(spark, folder, "documents")
    arriving_at, checkpoint, store = new_folder(spark, "arriving"), new_folder(spark, "progress"), Store(spark, new_folder(spark, "published"))
    for batch in range(3):
        docs.where(f"doc_id % 3 = {batch}").write.mode("append").parquet(arriving_at)
        now = listed if batch < 2 else listed.withColumn("value_hash", F.lit("old"))
        files = from_table(read_new(spark, arriving_at, docs.schema), _PATH, "text")
        drain_published(files, store, MASKED, lambda now=now: now, checkpoint)
    return store.read("findings", FOUND).select("path", "line", "rule", "batch", "changed")

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
#: Whether Spark deletes the exchanges of a query with its end, and not when the driver
#: happens to collect its garbage.
AT_ONCE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only where a local session has
    none, it gets a temporary folder, which is then its checkpoint folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="maskwright-llm-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_folder(spark)}/maskwright-llm/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back: lineage ends here, so a lost executor
    costs no more than the step that follows.  Its exchanges go at once, so the disk
    holds those of one step."""
    spark = df.sparkSession
    folder, before = new_folder(spark, label), spark.conf.get(AT_ONCE, None)
    spark.conf.set(AT_ONCE, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(AT_ONCE) if before is None else spark.conf.set(AT_ONCE, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_at = folder
    return out


def mark(spark: SparkSession) -> int:
    """How many tables this session has stored so far."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what this session stored after ``mark`` gave ``since``, but for one table.
    Call it when all results have been written; results that still read the deleted
    tables fail afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = _written.get(spark.sparkContext.applicationId, [])
    left = []
    for folder in own[since:]:
        if folder == getattr(keep, "stored_at", None):
            left.append(folder)
            continue
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    own[since:] = left

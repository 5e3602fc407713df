"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}
_local_root: dict[str, str] = {}


def build_session(app: str = "maskwright", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a local session may go
    without the setting; it gets a temporary folder of its own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_root:
        _local_root[context.applicationId] = tempfile.mkdtemp(prefix="maskwright-")
    return _local_root[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/maskwright/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` stores inside is deleted at the end: such tables may hold
    values in the clear.  Results that are still read later must be written elsewhere."""
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            delete(spark, folder)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder, which goes at the end of the open ``scratch`` if there is one."""
    folder = new_folder(spark, label)
    if _open:
        _open[-1].append(folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession, size: int = 64 << 20) -> Iterator[None]:
    """Rows that are sent to Python inside are batched by bytes, not only by number."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back, so that later steps neither recompute
    it nor depend on its lineage when executors are lost."""
    folder = scratch_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def kept(df: DataFrame, label: str, below: str | None = None) -> DataFrame:
    """Stored for the caller (below a folder of theirs, if they name one), also after
    the scratch tables that it was made from are gone."""
    folder = f"{below}/{label}" if below else new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

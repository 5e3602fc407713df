"""Listing a tree of files as Spark jobs.

The driver knows the root only.  Each job takes a table of folders that are still open:
a task walks its folders until it has seen ``ENTRIES`` names, writes the files it found
in batches, and hands the folders that it has not opened to the next job.  So a folder
with millions of names streams through one task, a broad tree spreads over all, and a
deep one needs a job per ``ENTRIES`` names, not one per level.

Symbolic links are left out, as are folders whose name is in ``skip``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_folder

ENTRIES = 20_000
BATCH = 10_000
LISTED = "path string, length bigint"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system and without dots or a final slash."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toUri().normalize().toString().rstrip("/")
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_system(uri: str):
    """The file system of a URI as tasks see it, and the path in it."""
    from urllib.parse import unquote

    from pyarrow import fs

    return (fs.LocalFileSystem(), unquote(uri[7:])) if uri.startswith("file://") else fs.FileSystem.from_uri(uri)


def in_folder(uri: str, folder: str) -> Iterator[tuple[str, int | None]]:
    """(path below the root, size or None for a folder) of one folder's entries."""
    system, top = file_system(uri)
    place = f"{top}/{folder}" if folder else top
    below = f"{folder}/" if folder else ""
    if uri.startswith("file://"):  # streams, and can tell links
        with os.scandir(place) as found:
            for entry in found:
                if not entry.is_symlink():
                    if entry.is_dir():
                        yield below + entry.name, None
                    elif entry.is_file():
                        yield below + entry.name, entry.stat().st_size
        return
    from pyarrow import fs

    for info in system.get_file_info(fs.FileSelector(place)):
        if info.type in (fs.FileType.File, fs.FileType.Directory):
            yield below + info.base_name, info.size if info.is_file else None


def _walk(uri: str, skip: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int | None]] = []

        def table() -> pa.RecordBatch:
            paths, sizes = zip(*rows) if rows else ((), ())
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])

        for batch in batches:
            for root in batch.column("path").to_pylist():
                waiting, seen = [root], 0
                while waiting:
                    folder = waiting.pop()
                    if seen >= ENTRIES:
                        rows.append((folder, None))
                        continue
                    for path, size in in_folder(uri, folder):
                        seen += 1
                        if size is not None:
                            rows.append((path, size))
                        elif path.rpartition("/")[2] not in skip:
                            waiting.append(path)
                        if len(rows) >= BATCH:
                            yield table()
        if rows:
            yield table()

    return run


def list_tree(spark: SparkSession, root: str, skip: Iterable[str] = ()) -> DataFrame:
    """Every file below ``root``, whatever its name: (path relative to root, length).
    Spark's own listing leaves out names that begin with a dot or an underscore."""
    from pyarrow import fs

    uri = qualified(spark, root)
    system, top = file_system(uri)
    if system.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no such folder: {root}")
    where, step = scratch_folder(spark, "file-list"), 0
    tasks = 8 * spark.sparkContext.defaultParallelism
    open_folders = spark.createDataFrame([("",)], "path string")
    while True:
        open_folders.repartition(tasks).mapInArrow(_walk(uri, frozenset(skip)), LISTED).write.parquet(f"{where}/step={step}")
        found = spark.read.schema(LISTED).parquet(f"{where}/step={step}")
        open_folders, step = found.where("length is null").select("path"), step + 1
        if not open_folders.take(1):
            return spark.read.schema(LISTED).parquet(f"{where}/step=*").where("length is not null")

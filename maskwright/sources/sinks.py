"""Where results go."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.history import safe_findings
from ..session import materialize, small_batches
from .listing import file_system, qualified


def check_apart(spark: SparkSession, output: str, input_root: str) -> None:
    """The output must lie outside the input tree, however the two are spelled."""
    out, root = (qualified(spark, x) + "/" for x in (output, input_root))
    if out.startswith(root) or root.startswith(out):
        raise ValueError("the output folder must lie outside the input folder")


def write_sanitized(staged: DataFrame, output: str, input_root: str) -> None:
    """Write (path, kind, text, copied, content), partitioned by kind; ``content`` is
    the bytes of copied files.  The input tree is never written to."""
    check_apart(staged.sparkSession, output, input_root)
    (
        staged.withColumn("kind", F.coalesce("kind", F.lit("other")))
        .write.partitionBy("kind").parquet(output)
    )


WRITTEN = "path string, length bigint, sha256 string, copied boolean"


def _written(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "length", "sha256", "copied"])


class _Place:
    """One file on its way: written under a name of its own, then moved, so a task that
    runs twice leaves whole files."""

    def __init__(self, system, root: str, path: str):
        self.system, self.path, self.place = system, path, f"{root}/{path}"
        folder = self.place.rpartition("/")[0]
        system.create_dir(folder, recursive=True)
        self.part = f"{folder}/.{uuid.uuid4().hex}.part"
        self.digest, self.length = hashlib.sha256(), 0
        self.out = system.open_output_stream(self.part, compression=None)

    def write(self, body: bytes) -> None:
        self.out.write(body)
        self.digest.update(body)
        self.length += len(body)

    def done(self, copied: bool) -> tuple:
        self.out.close()
        self.system.move(self.part, self.place)
        return self.path, self.length, self.digest.hexdigest(), copied

    def drop(self) -> None:
        self.out.close()
        self.system.delete_file(self.part)


def _write_at_places(cut: DataFrame, target: str) -> DataFrame:
    """Put parts (path, part, text) of files together in a mounted folder: every part is
    written at its place in a file under another name, by whatever task has it; then one
    task a file takes the SHA-256 of it, in pieces, since that needs all bytes in order,
    and moves it.  Only numbers of parts meet in one place.  Returns ``WRITTEN``."""
    _, root = file_system(target)
    run = uuid.uuid4().hex

    def names(path: str) -> tuple[str, str]:
        place = f"{root}/{path}"
        return place, f"{place.rpartition('/')[0]}/.{hashlib.md5(path.encode()).hexdigest()}-{run}.part"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, text, begin = (batch.column(c)[i].as_py() for c in ("path", "text", "begin"))
                _, part = names(path)
                os.makedirs(os.path.dirname(part), exist_ok=True)
                file, body = os.open(part, os.O_WRONLY | os.O_CREAT, 0o666), memoryview(text.encode())
                try:
                    while body:
                        done = os.pwrite(file, body, begin)
                        body, begin = body[done:], begin + done
                finally:
                    os.close(file)
            yield batch.select(["path", "part"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                place, part = names(path)
                digest, read = hashlib.sha256(), 0
                with open(part if os.path.exists(part) else place, "rb") as file:  # moved already if a task runs twice
                    while piece := file.read(16 << 20):
                        digest.update(piece)
                        read += len(piece)
                if read != length:
                    raise OSError(f"{path} has {read} bytes instead of {length}")
                if os.path.exists(part):
                    os.replace(part, place)
                yield _written([(path, length, digest.hexdigest(), False)])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if os.path.exists(names(path)[1]):
                    os.remove(names(path)[1])
            yield batch.select(["path"])

    tasks = 4 * cut.sparkSession.sparkContext.defaultParallelism
    cut = materialize(cut.repartition(tasks, "path", "part"), "cut-files")
    sizes = cut.selectExpr("path", "part", "cast(octet_length(text) as bigint) as size")
    order = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = materialize(sizes.withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0))), "places")
    files = places.groupBy("path").agg(F.sum("size").alias("length"))
    try:
        placed = cut.join(places.drop("size"), ["path", "part"]).select("path", "part", "text", "begin")
        materialize(placed.mapInArrow(write, "path string, part bigint"), "written-parts")
        return materialize(files.repartition("path").mapInArrow(move, WRITTEN), "written-whole")
    except BaseException:
        files.select("path").mapInArrow(drop, "path string").count()
        raise


def write_tree(staged: DataFrame, output: str, input_root: str) -> DataFrame:
    """Write every file of (path, text, copied, content) to its place below ``output``.

    Copied files keep their bytes; one that was not loaded is copied from the input in
    pieces.  Parts of a file (``part`` of ``parts``) are written by all tasks at their
    places where the file system is mounted, else by one task a file, a part at a time.
    Returns (path, length, sha256, copied).
    """
    spark = staged.sparkSession
    check_apart(spark, output, input_root)
    target, source = qualified(spark, output), qualified(spark, input_root)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_system, out_root = file_system(target)
        in_system, in_root = file_system(source)
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                file = _Place(out_system, out_root, row["path"])
                try:
                    if not row["copied"]:
                        file.write((row["text"] or "").encode())
                    elif row["content"] is not None:
                        file.write(row["content"])
                    else:
                        with in_system.open_input_stream(f"{in_root}/{row['path']}", compression=None) as big:
                            while piece := big.read(16 << 20):
                                file.write(piece)
                except BaseException:
                    file.drop()
                    raise
                done.append(file.done(row["copied"]))
            yield _written(done)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(target)
        file = None
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    path, text, last = (batch.column(c)[i].as_py() for c in ("path", "text", "last"))
                    file = file or _Place(system, root, path)
                    file.write((text or "").encode())
                    if last:
                        file, made = None, file.done(False)
                        yield _written([made])
        finally:
            if file is not None:
                file.drop()

    columns = ["path", "text", "copied", "content"]
    if "parts" not in staged.columns:
        return materialize(staged.select(columns).mapInArrow(whole, WRITTEN), "written-files")
    with small_batches(spark):
        if target.startswith("file://"):
            cut = _write_at_places(staged.where("parts > 1").select("path", "part", F.coalesce("text", F.lit("")).alias("text")), target)
        else:
            cut = staged.where("parts > 1").selectExpr("path", "part", "text", "part = parts - 1 as last")
            cut = cut.repartition("path").sortWithinPartitions("path", "part").mapInArrow(together, WRITTEN)
        return materialize(staged.where("parts = 1").select(columns).mapInArrow(whole, WRITTEN).unionByName(cut), "written-files")


def record_scan(findings: DataFrame, folder: str, project_id: int, scan_id: int, scanned_at: str) -> None:
    """Append the findings of a scan without any value, one partition per project."""
    (
        safe_findings(findings)
        .withColumn("scan_id", F.lit(scan_id).cast("bigint"))
        .withColumn("scanned_at", F.to_timestamp(F.lit(scanned_at)))
        .withColumn("project_id", F.lit(project_id).cast("bigint"))
        .write.mode("append").partitionBy("project_id").parquet(folder)
    )


def write_results(table: DataFrame, folder: str, fmt: str = "json") -> None:
    """Result tables as JSON lines or as CSV with a header and NA for null."""
    writer = table.write
    if fmt == "csv":
        writer.option("header", "true").option("nullValue", "NA").csv(folder)
    else:
        writer.option("ignoreNullFields", "false").json(folder)

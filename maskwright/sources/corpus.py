"""Corpus tables: from a file tree or a table, to lines and back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Sql
from .listing import file_system, list_tree, qualified

#: Files beyond this are passed on without being loaded: a cell of a table holds less.
LARGEST_CELL = (1 << 31) - (1 << 20)
BATCH_BYTES = 32 << 20
PIECE = 16 << 20


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Add the bytes of each listed file to its row; null where it is too large to load
    (``parts`` reads such files)."""
    spark = files.sparkSession
    uri = qualified(spark, root)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(uri)
        for batch in batches:
            first, bodies, held = 0, [], 0
            for i, (path, length) in enumerate(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())):
                body = None
                if length <= LARGEST_CELL:
                    with system.open_input_stream(f"{top}/{path}", compression=None) as file:
                        body = file.read()
                bodies.append(body)
                held += len(body or b"")
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    rows = batch.slice(first, len(bodies))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(bodies, pa.binary())], [*rows.schema.names, "content"])
                    first, bodies, held = i + 1, [], 0

    return files.mapInArrow(load, f"{kind}, content binary")


def with_hash(files: DataFrame, root: str) -> DataFrame:
    """Add the SHA-256 of each listed file, read in pieces whatever its size."""
    uri = qualified(files.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(uri)
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with system.open_input_stream(f"{top}/{path}", compression=None) as file:
                    while piece := file.read(PIECE):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], ["path", "length", "hash"])

    return files.select("path", "length").mapInArrow(run, "path string, length bigint, hash string")


def read_tree(spark: SparkSession, root: str, part_bytes: int = 0) -> DataFrame:
    """Every file below ``root``: (path relative to root, length, part, parts, content).
    Large files come in parts of whole lines, so no task holds one."""
    from .parts import read_lines

    return read_lines(list_tree(spark, root), root, part_bytes)


def normalise_newlines(text: Sql) -> Sql:
    return f"if(contains({text}, '\\r'), regexp_replace({text}, '\\r\\n?', '\\n'), {text})"


def valid_text(content: Sql) -> Sql:
    """Bytes as text, with invalid UTF-8 dropped.

    ``make_valid_utf8`` marks invalid bytes with U+FFFD.  A U+FFFD that was in the
    file is escaped before and restored after, so only the marks disappear.
    """
    raw = f"cast({content} as string)"
    escaped = f"replace(replace({raw}, '\\uFDD0', '\\uFDD0a'), '\\uFFFD', '\\uFDD0b')"
    cleaned = f"replace(make_valid_utf8({escaped}), '\\uFFFD', '')"
    restored = f"replace(replace({cleaned}, '\\uFDD0b', '\\uFFFD'), '\\uFDD0a', '\\uFDD0')"
    return f"if(is_valid_utf8({raw}), {raw}, {restored})"


def decode_text(files: DataFrame) -> DataFrame:
    """Add ``text``: UTF-8 without invalid bytes, line ends as \\n."""
    return files.withColumn("text", F.expr(normalise_newlines(valid_text("content"))))


def from_table(df: DataFrame, path_expr: Sql, text_col: str) -> DataFrame:
    """Rows of any table as files: (path, text, length, content)."""
    return df.selectExpr(
        f"{path_expr} as path",
        f"{normalise_newlines(text_col)} as text",
        f"cast(octet_length({text_col}) as bigint) as length",
        f"encode({text_col}, 'UTF-8') as content",
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """``files(path, text)`` to (path, line_no, line, eol).  A final newline ends
    the last line; it does not start another.

    The outer explode keeps Catalyst from adding a filter that splits the text a
    second time; a null text has no line and drops out in the filter here.
    """
    return (
        files.selectExpr("path", "split(text, '\\n', -1) as pieces")
        .selectExpr("path", "size(pieces) as n", "posexplode_outer(pieces) as (pos, line)")
        .where("not (pos = n - 1 and line = '')")
        .selectExpr("path", "pos + 1 as line_no", "line", "if(pos < n - 1, '\\n', '') as eol")
    )


def rebuild(lines: DataFrame, lines_per_chunk: int | None = None) -> DataFrame:
    """(path, line_no, line, eol) back to text: (path, chunk, text).

    One text per file, or with ``lines_per_chunk`` one per so many lines, for files
    whose text would not fit a cell; chunks in order give the file.
    """
    chunk = "0" if lines_per_chunk is None else f"cast((line_no - 1) div {lines_per_chunk} as int)"
    return (
        lines.withColumn("chunk", F.expr(chunk))
        .groupBy("path", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat("line", "eol").alias("t")))).alias("ls"))
        .selectExpr("path", "chunk", "array_join(ls.t, '') as text")
    )

"""WARC archives of pages, written and read back in splits.

Every record is one gzip member.  A payload that an earlier record holds is not stored
again but revisited.  Reading tasks take byte ranges: they look for the gzip magic,
validate a candidate by decoding it (a member must begin with a WARC version and pass its
checksum), and own the records that start inside their range, also where these end beyond.

Archives go to a folder that all executors share, through ``pyarrow.fs`` (local and
network mounts, HDFS, S3, GCS).  A task writes files of its own name and reports them; only
reported files are read, so what a lost or repeated task left behind does no harm.

Nulls are empty payloads.  Pages without an id keep none.  Of pages with one id and one
payload, all are responses.  Control characters in a URL are percent-encoded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

SMALLEST_REVISIT = 100
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BROADCAST_ROWS = 200_000
READ = 1 << 20
RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
FIELDS = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int) -> bytes:
    """One compressed record.  A revisit keeps the HTTP head, which states the length."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    target = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http;msgtype=response"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str, most_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out = name = None
        size = records = 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"name": [name], "size": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, refers = (batch.column(i)[row].as_py() for i in range(5))
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                packed = member(page, url, payload, digest, refers, level)
                out.write(packed)
                size, records = size + len(packed), records + 1
                if size >= most_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html",
                   most_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write ``pages`` below ``folder``; returns the archives (name, size, records)."""
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    shared = storage.stored(
        rows.where(F.octet_length("html") >= SMALLEST_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "shared-payloads"
    )
    small = shared.count() <= BROADCAST_ROWS
    named = rows.join(F.broadcast(shared) if small else shared, "digest", "left").select(
        "page_id", "url", F.expr("cast(html as binary)").alias("payload"), "digest", F.expr("if(page_id <=> first, null, first)").alias("refers_to")
    )
    return storage.stored(named.mapInArrow(_write(folder, most_bytes, level), "name string, size bigint, records bigint"), "archives")


class Range:
    """Sequential bytes of an archive from a place on, read a block at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.block = file, size, 0, b""

    def get(self, place: int, n: int = READ) -> bytes:
        """At least one and up to ``n`` bytes from ``place``, none at the end."""
        if not self.at <= place < self.at + len(self.block):
            self.at, self.block = place, self.file.read_at(min(READ, max(0, self.size - place)), place)
        return self.block[place - self.at : place - self.at + n]


def next_magic(source: Range, place: int, end: int) -> int | None:
    """The first place in [place, end) where a gzip member may begin."""
    while place < end:
        block = source.get(place)
        found = block.find(MAGIC)
        if found >= 0:
            return place + found if place + found < end else None
        if len(block) < len(MAGIC):
            head = block + source.get(place + len(block), len(MAGIC)) if block else b""
            if head.startswith(MAGIC):
                return place
            place += max(1, len(block))
        else:
            place += len(block) - len(MAGIC) + 1
    return None


def read_member(source: Range, place: int) -> tuple[bytes, int] | None:
    """The record of the member at ``place`` and where it ends; None if it is none."""
    unpacker, out, at = zlib.decompressobj(31), [], place
    length = 0
    try:
        while not unpacker.eof:
            block = source.get(at)
            if not block:
                return None
            out.append(unpacker.decompress(block))
            at += len(block) - len(unpacker.unused_data)
            length += len(out[-1])
            if length >= 7 and not b"".join(out[:2])[:7].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    record = b"".join(out)
    return (record, at) if record.startswith(b"WARC/1.") else None


def parse(record: bytes) -> tuple:
    """The fields of a record; the digest is that of the payload that was read."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    page, url = number(fields["warc-record-id"]), fields["warc-target-uri"]
    if fields["warc-type"] == "revisit":
        lines = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        return page, url, None, int(lines["Content-Length"]), stated, "revisit", number(fields["warc-refers-to"])
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"record {fields['warc-record-id']} does not have the digest that it states")
    return page, url, payload, len(payload), digest, "response", None


def _read(folder: str, split_bytes: int, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "start"))):
                with system.open_input_file(f"{root}/{name}") as file:
                    source, place, end = Range(file, size), start, min(start + split_bytes, size)
                    rows, held = [], 0
                    while (place := next_magic(source, place, end)) is not None:
                        found = read_member(source, place)
                        if found is None:
                            place += 1
                            continue
                        record, place = found
                        fields = parse(record)
                        rows.append(fields if with_payload else (*fields[:2], None, *fields[3:]))
                        held += len(record)
                        if held > 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    return run


def read_archives(archives: DataFrame, folder: str, split_bytes: int = 64 << 20, with_payload: bool = True) -> DataFrame:
    """Records of the archives (name, size), read in ranges of ``split_bytes``."""
    splits = archives.where("size > 0").selectExpr("name", "size", f"explode(sequence(0L, size - 1, {split_bytes}L)) as start")
    n = archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    return splits.repartition(int(min(n, 20_000)), "name", "start").mapInArrow(_read(folder, split_bytes, with_payload), RECORD)

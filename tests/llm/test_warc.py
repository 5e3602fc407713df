import gzip
import hashlib
import random

import pytest

from maskwright.llm import storage, warc


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(7)
    bodies = [("é<p>" + "".join(rng.choice("abcdef <>\n") for _ in range(n))) for n in (0, 10, 95, 96, 97, 400, 5000, 200_000)]
    rows = [(i, f"https://a.example/{i}\r\n x", rng.choice(bodies)) for i in range(90)]
    rows += [(200, None, None), (201, "u", ""), (None, "no id", bodies[5]), (3, *rows[3][1:]), (3, *rows[3][1:]), (202, "w", "WARC/1.1\r\n\r\n" * 30)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def want(rows):
    first = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = first.get(html)
        to = None if to == i else to
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=str)


@pytest.mark.parametrize("split_bytes, most_bytes", [(1 << 26, 1 << 30), (997, 1 << 30), (64, 20_000)])
def test_round_trip_whatever_the_splits(spark, pages, split_bytes, most_bytes):
    rows, df = pages
    folder = storage.new_folder(spark, "warc-test")
    archives = warc.write_archives(df, folder, most_bytes=most_bytes)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    records = warc.read_archives(archives, folder, split_bytes=split_bytes)
    assert got(records) == want(rows)
    payloads = sorted(bytes(r.payload) for r in records.where("record_type = 'response'").collect())
    assert len(payloads) == sum(r[3] == "response" for r in want(rows))


def test_files_are_plain_gzip_and_leftovers_are_not_read(spark, pages, tmp_path):
    rows, df = pages
    folder = f"file://{tmp_path}"
    archives = warc.write_archives(df, folder)
    names = {r.name for r in archives.collect()}
    text = b"".join(gzip.decompress((tmp_path / n).read_bytes()) for n in names)
    assert text.count(b"WARC-Record-ID") == len(rows)
    (tmp_path / "left-by-a-lost-task.warc.gz").write_bytes(b"\x1f\x8b\x08 broken")
    assert warc.read_archives(archives, folder).count() == len(rows)


def test_false_magic_and_broken_members(tmp_path):
    """Bytes that look like a member but are none are passed over."""
    good = warc.member(1, "u", b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), None, 6)
    other = gzip.compress(b"no record")
    broken = good[:-6] + b"\0\0\0\0\0\0"
    body = b"\x1f\x8b\x08junk" + other + broken + good + b"\x1f\x8b" + good + b"\x1f\x8b\x08"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(body)
    system, root = warc.file_system(f"file://{path}")
    for step in (7, 50, 10_000):
        places = []
        for start in range(0, len(body), step):
            source, place, end = warc.Range(system.open_input_file(root), len(body)), start, min(start + step, len(body))
            while (place := warc.next_magic(source, place, end)) is not None:
                found = warc.read_member(source, place)
                if found:
                    places.append(place)
                place = found[1] if found else place + 1
        assert places == [body.index(good, len(body) - 2 * len(good) - 5), len(body) - 3 - len(good)]


def test_empty_table_and_wrong_digest(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = storage.new_folder(spark, "warc-test")
    assert warc.read_archives(warc.write_archives(empty, folder), folder).count() == 0
    with pytest.raises(ValueError):
        record, _ = warc.read_member(_Bytes(warc.member(1, "u", b"abc", "0" * 64, None, 6)), 0)
        warc.parse(record)


class _Bytes:
    def __init__(self, body):
        self.body = body

    def get(self, place, n=1 << 20):
        return self.body[place : place + n]

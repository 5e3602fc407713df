import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import suffix_dedup as d
from maskwright.llm.induced import permuted_common_prefixes, suffix_array


def brute(rows):
    """Per row in order of (id, position): counts and digest."""
    seen, out = {}, []
    for key, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 99):
            first = seen.setdefault(body[i : i + 100], (key, i))
            if first != (key, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def results(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()]


@pytest.fixture(scope="module")
def repeats():
    """Shared passages of lengths around 100 bytes, copies, periods, edits, one letter."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    passages = [" ".join(word() for _ in range(60))[: rng.choice([98, 99, 100, 101, 130, 260])] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(passages), word()]
        rows.append((i, "".join(parts)))
    rows += [(60, rows[3][1]), (61, rows[3][1][:200] + "Z" + rows[3][1][201:]), (62, "a" * 3000), (63, "a" * 150 + "b"), (64, "xyz" * 200), (65, "q" + "xyz" * 40)]
    rows += [(66, passages[5] * 3), (67, "é" * 60), (68, "")]
    return rows


@pytest.mark.parametrize("most_segments", [24, 1])
def test_equals_brute_force(spark, table, repeats, most_segments):
    """Also where every anchor counts as crowded."""
    found = d.without_repeats(table(repeats), most_segments=most_segments).orderBy("doc_id")
    assert results(found) == brute(repeats)


def test_odd_rows(spark, table):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(120_000))
    rows = [(None, long[:500]), (None, None), (1, None), (2, ""), (3, long), (4, "short"), (5, "r" * 40 + long[90_000:91_000]), (5, "r" * 40 + long[90_000:91_000]), (6, long[100:300])]
    found = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in d.without_repeats(table(rows)).collect()}
    want = brute([*dict.fromkeys(rows)])
    assert found == {(k, w[0]): w[1:3] for (k, _), w in zip(dict.fromkeys(rows), want)}
    assert d.without_repeats(table(rows)).count() == len(rows)
    assert d.without_repeats(table(rows).limit(0)).count() == 0


def test_one_id_with_two_texts(spark, table):
    body = "".join(chr(97 + (i * 7 + i // 5) % 26) for i in range(130))
    found = d.without_repeats(table([(1, body + "A"), (1, body + "B")])).collect()
    assert sorted(r.n_removed for r in found) == [0, 130]


def grouped(groups):
    key = [g * 300 + c + 1 for g, x in enumerate(groups) for c in (*x, -1)]
    return np.unique(np.array(key), return_inverse=True)[1], np.array([len(x) + 1 for x in groups])


def test_induced_sorting_equals_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s, sizes = grouped([list(rng.integers(0, rng.integers(2, 5), rng.integers(0, 40))) for _ in range(rng.integers(1, 6))])
        array, text = suffix_array(s, sizes), s.tolist()
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = permuted_common_prefixes(s, sizes, array, 5)
        for a, b in zip(array[1:], array[:-1]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert min(n, 5) == min(common[a], 5)
    assert len(suffix_array(np.zeros(0, int), np.zeros(0, int))) == 0


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 99, 300)
    for width in (1, 2, 5, 69, 64):
        assert d.sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(300 - width + 1)]


def test_the_second_hash_of_a_window_does_not_follow_from_the_first(spark):
    rows = spark.range(200).selectExpr("encode(concat('window ', id), 'utf-8') as body")
    same = rows.selectExpr(f"{d.ROUTE} = xxhash64(body) as route", f"{d.CONTENT} = xxhash64(body, 1) as chained", f"{d.CONTENT} as content")
    found = same.collect()
    assert all(r.route for r in found) and not any(r.chained for r in found) and len({r.content for r in found}) == 200


def test_lines_that_collide_under_polynomials_stay(spark, table, thue_morse):
    a, b = thue_morse
    found = d.without_repeats(table([(1, a), (2, b)])).orderBy("doc_id")
    assert results(found) == brute([(1, a), (2, b)])


def test_long_texts_are_cut_in_pieces(spark, table, repeats, monkeypatch):
    """Every executor thread handles pieces of 150 bytes, so all strings cross pieces."""
    rows = [(i, t * 3) for i, t in repeats]
    for batch in (d._pieces(np.zeros(5000, np.uint8), np.array([0, 5000])), d._pieces(np.zeros(70, np.uint8), np.array([0, 70]))):
        assert sum(len(p) for _, p, _ in batch) in (5000, 70)
    monkeypatch.setattr(d, "PIECE", 150)
    whole, cut = d.Cutter(), []
    for _, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        cut.append(sum(int(whole.segments(part, bounds)[2].sum()) for _, part, bounds in d._pieces(data, np.array([0, len(data)]))))
    assert cut == [max(0, len(t.encode()) - 99) for _, t in rows]  # every window once
    assert results(d.without_repeats(table(rows)).orderBy("doc_id")) == brute(rows)


def test_memory_of_one_text_of_64_mb():
    text = np.random.default_rng(1).integers(97, 123, 64 << 20, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([text])], ["id", "tie", "text"])
    ranges = pa.array([[{"start": 1000 * i, "n": 50} for i in range(60_000)]], pa.list_(pa.struct({"start": pa.int64(), "n": pa.int64()})))
    other = pa.RecordBatch.from_arrays([pa.array([1]), batch.column("text"), ranges], ["doc_id", "text", "ranges"])
    del text
    tracemalloc.start()
    n = sum(int(np.abs(b.column("n").to_numpy()).sum()) for b in d._cut(iter([batch])))
    left = next(d._kept(iter([other])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == (64 << 20) - 99 and left.column("n_removed").to_pylist() == [60_000 * 149]
    assert peak < 400 << 20

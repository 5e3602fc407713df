import random
import re

import pytest

from maskwright.llm import winnowing as w

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(w.UPPER, w.LOWER)


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        n = min(len(own), 10)
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    make = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    rows = [(i, make(n)) for i, n in enumerate([10, 11, 25, 40, 9, 4, 3, 1, 30])]
    return rows + [(20, rows[3][1]), (21, "W1, w2! W3"), (22, None), (23, ""), (None, make(12)), (24, "a a a a a a a a a a a a"), (25, "Ünï éé ßß w1 w2 w3 w4 w5 w6 w7 w8")]


@pytest.fixture(scope="module")
def rows(items):
    rng = random.Random(2)
    out = []
    for i in range(60):
        parts = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 30))]
        own = split(rng.choice(items)[1])
        at = rng.randrange(0, max(1, len(own) - 8))
        parts += own[at : at + rng.choice([8, 9, 10, 11, 30])] + [f"z{i}"] * rng.randrange(0, 3)
        out.append((i, ("., "[i % 3] + " ").join(p.upper() if rng.random() < 0.2 else p for p in parts)))
    return out + [(100, "b a a a a a a a a a a a a a a b"), (101, "ünï éé ßß w1 w2 w3 w4 w5 w6 w7 w8"), (102, "Ünï éé ßß W1 w2 w3 w4 w5 w6 w7 w8")]


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in df.collect()), key=str)


def test_equals_brute_force(spark, table, items, rows):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(w.hits(table(rows), bench)) == sorted(((i, *brute(t, items)) for i, t in rows), key=str)


def test_without_broadcast_and_clean(spark, table, items, rows, monkeypatch):
    monkeypatch.setattr(w, "BROADCAST_ROWS", 0)
    long_items = [x for x in items if len(split(x[1])) >= 10]
    bench = spark.createDataFrame(long_items, "item_id bigint, text string")
    docs = table(rows)
    kept = w.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in rows if not brute(t, long_items)[1]]


def test_odd_rows_and_empty_tables(spark, table, odd_rows):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (2, "word1 of1 word2 of2 word3 of3 word4 of4 word5 of5 word6 of6")], "item_id bigint, text string")
    docs = table(odd_rows)
    got = found(w.hits(docs, bench))
    want = sorted(((i, *brute(t, [(r.item_id, r.text) for r in bench.collect()])) for i, t in odd_rows), key=str)
    assert got == want
    assert w.hits(docs.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in w.hits(docs, bench.limit(0)).collect())


def test_no_python_in_the_plan(spark, table, items, rows):
    plan = w.hits(table(rows), spark.createDataFrame(items, "item_id bigint, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

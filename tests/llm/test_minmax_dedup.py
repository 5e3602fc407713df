import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import minmax_dedup as d
from maskwright.llm import storage, texthash
from maskwright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, percent):
    """Classes of row numbers."""
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return sets, label


@pytest.fixture(scope="module")
def near_rows():
    """Copies, near copies at many distances from the threshold, chains, unrelated texts."""
    rng = random.Random(4)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, 9)):
            rows.append(" ".join(words))
            words = list(words) if rng.random() < 0.5 else words[: rng.randrange(15, len(words) + 1)]
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("options", [{}, {"cluster_rows": 1, "block": 3}, {"cluster_shingles": 300, "block": 2}])
def test_classes_equal_brute_force(spark, table, near_rows, options):
    """Also where all clusters are too large for one task."""
    sets, label = brute(near_rows, 3, 85)
    lowest = {}
    for (i, _), c in zip(near_rows, label):
        lowest[c] = min(lowest.get(c, i), i)
    found = d.near_duplicates(table(near_rows), 3, 85, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {
        i: (len(s), lowest[c]) for (i, _), s, c in zip(near_rows, sets, label)
    }


def test_sets_of_giant_clusters_never_reach_the_driver(spark, table, near_rows, monkeypatch):
    """Also with repeated rows, whose shingles count once, and in several rounds."""
    rows = near_rows + near_rows[::3]
    base = [f"b{i}" for i in range(60)]  # one loose cluster: neighbours are links, ends are not
    rows += [(1000 + i, " ".join([*base[:60 - i], *(f"c{j}" for j in range(i))])) for i in range(12)]
    sets, label = brute(rows, 3, 85)
    lowest = {}
    for (i, _), c in zip(rows, label):
        lowest[c] = min(lowest.get(c, i), i)
    docs = table(rows)
    collect = type(docs).collect

    def watched(self):
        assert "hashes" not in self.columns
        return collect(self)

    monkeypatch.setattr(type(docs), "collect", watched)
    monkeypatch.setattr(d, "ROUND_PAIRS", 40, raising=False)
    found = d.near_duplicates(docs, 3, 85, cluster_rows=1, block=8).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), lowest[c]) for (i, _), s, c in zip(rows, sets, label)}


def test_giant_clusters_give_no_row_per_pair(spark, monkeypatch):
    """All members linked with all: a task gives a link per member and per query at most,
    in however many blocks and parts they meet, and together they connect all."""
    n = 60
    sets = spark.createDataFrame([(1 + i // n, i, [*range(100), 1000 + i]) for i in range(2 * n)], "cluster bigint, node bigint, hashes array<bigint>")
    assert d._links(sets, sets, 85).count() < 2 * 2 * n  # two clusters, a block and a part each
    monkeypatch.setattr(d, "ROUND_SHINGLES", 30 * 101, raising=False)  # two parts and blocks
    links = d._links(sets, sets, 85, block=1).collect()
    assert len(links) < 2 * 2 * 2 * 2 * n
    assert {(a // n, b // n) for a, b in links} == {(0, 0), (1, 1)}
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in found} == {i: i // n * n for i in range(2 * n)}


@pytest.mark.parametrize("shingles, pairs", [(1 << 20, 1), (90, 1 << 20), (90, 200)])
def test_giant_clusters_in_blocks_and_parts_equal_brute_force(spark, table, near_rows, monkeypatch, shingles, pairs):
    monkeypatch.setattr(d, "ROUND_SHINGLES", shingles, raising=False)
    monkeypatch.setattr(d, "ROUND_PAIRS", pairs)
    sets, label = brute(near_rows, 3, 85)
    lowest = {}
    for (i, _), c in zip(near_rows, label):
        lowest[c] = min(lowest.get(c, i), i)
    found = d.near_duplicates(table(near_rows), 3, 85, cluster_rows=1, block=1).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: lowest[c] for (i, _), c in zip(near_rows, label)}


def test_stored_steps_leave_no_exchange(spark):
    """else those of all steps lie on the disk together, until the driver collects its garbage."""
    master = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before, was = master.shuffleStatuses().size(), spark.conf.get(storage.AT_ONCE, None)
    kept = [storage.stored(spark.range(1000).selectExpr("id % 7 as a", "id").groupBy("a").count(), "test-exchange") for _ in range(3)]
    assert master.shuffleStatuses().size() <= before and spark.conf.get(storage.AT_ONCE, None) == was
    assert [x.count() for x in kept] == [7, 7, 7]


def test_one_of_each_keeps_columns_and_rows(spark, table, near_rows):
    docs = table(near_rows)
    kept = d.one_of_each(docs, words_per_shingle=3, percent=85)
    _, label = brute(near_rows, 3, 85)
    assert kept.columns == docs.columns and kept.count() == len(set(label))


def test_odd_rows(spark, table, odd_rows):
    docs = table(odd_rows)
    found = d.near_duplicates(docs).collect()
    assert len(found) == len(odd_rows)
    assert sorted(r.n_shingles for r in found)[:4] == [0, 0, 0, 0]
    assert all(r.component_id == r.doc_id for r in found)
    assert d.near_duplicates(docs.limit(0)).count() == 0
    kept = [r.text for r in d.one_of_each(docs).collect()]
    assert kept.count("same row twice over and over") == 1 and len(kept) == len(odd_rows) - 1


def test_rows_without_id_join_a_class(spark, table):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "p q r s t u v")]
    found = {(r.doc_id, r.component_id) for r in d.near_duplicates(table(rows), 3, 85).collect()}
    assert found == {(None, 3), (3, 3), (None, None)}


def test_signature_agreement_is_unbiased():
    """Minima and maxima both agree with the probability of the Jaccard similarity."""
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(30):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = np.sort(pool[:240]), np.sort(pool[60:])  # 180 of 300 in common
        flip, factor = rng.integers(0, 1 << 63, (2, 50), dtype=np.uint64)
        for f, m in zip(flip, factor | np.uint64(1)):
            x, y = (a ^ f) * m, (b ^ f) * m
            agree += [x.min() == y.min(), x.max() == y.max()]
    assert abs(np.mean(agree) - 0.6) < 0.03
    assert (1 - 0.85**d.ROWS) ** d.bands_for(85) < 1.01e-7


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (100, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_that_collide_under_polynomials_are_not_linked(spark, table, thue_morse):
    found = d.near_duplicates(table([(1, thue_morse[0]), (2, thue_morse[1])]), 3, 85).collect()
    assert {r.component_id for r in found} == {1, 2}


def test_a_long_text_in_pieces_has_the_same_set(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["Word", "é", "b" * 50, "x"]) + rng.choice([" ", "\n", "   "]) for _ in range(300))
    for t in (text, "one", " ", "two words"):
        for k in (3, 5):
            shingler = d.Shingler(k)
            whole, bounds = shingler.sets(pa.array([t]))
            monkeypatch.setattr(texthash, "PIECE", 11)
            assert shingler.long_set(np.frombuffer(t.encode(), np.uint8)).tolist() == whole.tolist() and len(whole) == len(shingles(t, k)) == bounds[-1]
            monkeypatch.undo()


def test_memory_of_one_text_of_32_mb():
    rng = np.random.default_rng(9)
    text = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 99999, 5_000_000))])
    tracemalloc.start()
    found, _ = d.Shingler(5).sets(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 4_900_000 and peak < 9 * text.nbytes

"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from maskwright.llm import hard_negatives as hn

EXTRA = ("id", "job", "is_row", "ints", "score", "rank", "part")


def brute(rows, every=10, n_positives=5, n_negatives=10):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    once = {}
    for i, l, v in sorted(good, key=lambda r: (r[1], r[2])):
        once.setdefault(i, (l, v))
    out = []
    for a, (label, x) in once.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, v)) for i, (_, v) in once.items() if i != a}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in first([i for i in score if once[i][0] == label])[:n_positives]:
            band = [i for i in score if once[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(first(band)[:n_negatives])]
    return sorted(out)


def found(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(*r, *("x",) * len(EXTRA)) for r in rows], f"vec_id bigint, label int, embedding array<{kind}>, " + ", ".join(f"`{c}` string" for c in EXTRA))
    return sorted(map(tuple, hn.mined(df, anchors="id % 10 = 0", **options).collect()))


def vectors(n, width, seed, labels=4, near=0.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=width) * near
    x = rng.normal(size=(n, width)) + middle
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    return [(i, int(rng.integers(labels)), [float(y) for y in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("width,near,levels", [(64, 0.5, 4), (64, 0.0, 1), (20, 1.0, 2), (130, 0.3, 3)])
def test_equals_brute_force(spark, width, near, levels):
    rows = vectors(400, width, width + levels, near=near)
    want = brute(rows)
    assert want and found(spark, rows, levels=levels) == want


def test_blocks_of_anchors_and_parts_of_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 8)
    monkeypatch.setattr(hn, "ROWS", 60)
    monkeypatch.setattr(hn, "PAIRS", 200)
    rows = vectors(300, 64, 5, near=0.6)
    assert found(spark, rows) == brute(rows)


def test_intervals_hold_the_scores_and_are_narrow():
    rng = np.random.default_rng(3)
    for scale in (1, 40, 3000):
        ints = rng.integers(-scale, scale + 1, (300, 64))
        ints[5] = 0
        codes, align, rest = hn.coded(ints.astype(float), hn.LEVELS)
        block = hn.Anchors(np.arange(50), np.zeros(50, int), ints[:50], hn.LEVELS)
        low, high = block.interval(np.arange(50), codes, align, rest, np.sqrt((ints**2).sum(axis=1)))
        exact = ints[:50] @ ints.T
        assert (low <= exact).all() and (exact <= high).all()
        lengths = np.sqrt((ints**2).sum(axis=1))
        assert np.median((high - low) / np.maximum(np.outer(lengths[:50], lengths), 1)) < 0.5


def test_ties_and_copies(spark):
    """One vector that a third of all rows have: ids decide."""
    rng = random.Random(1)
    rows = vectors(300, 64, 9, near=0.8)
    common = rows[7][2]
    rows = [(i, l, common if i % 3 == 0 else v) for i, l, v in rows]
    assert found(spark, rows) == brute(rows)
    small = [(i, rng.randrange(2), [rng.randrange(0, 2) / 256 for _ in range(3)]) for i in range(200)]
    assert found(spark, small) == brute(small)


def test_odd_rows(spark):
    rows = vectors(150, 8, 11, near=1.0)
    odd = [(None, 1, [1.0] * 8), (151, None, [1.0] * 8), (152, 1, None), (153, 1, [1.0, None]), (160, 1, [float("nan")] * 8), (170, 2, [float("inf")]),
           (180, 1, []), (190, 1, [0.5] * 20), (200, 2, [0.0] * 8), (-10, 1, [0.3] * 8), (4, 0, [0.1] * 8), (10, 3, [0.2] * 8), (20, *rows[20][1:])]
    assert found(spark, rows + odd) == brute(rows + odd)


def test_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(x) for x in rng.integers(1, 5, 4) * 10.0**6]) for i in range(60)]
    assert found(spark, rows, "double") == brute(rows)
    huge = [(i, i % 2, [float(x) for x in rng.integers(1, 9, 4) * 10.0**30]) for i in range(30)]
    assert {r[4:] for r in found(spark, huge, "double", high=100, low=100)} == {(hn.HIGHEST, hn.HIGHEST)}  # scores are held to longs


def test_no_rows_and_no_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
    assert found(spark, [(10, 1, [1.0])]) == []

"""Joins, windows, summaries, accuracy and statistics on small tables."""

import collections
import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright import fixed_values as fv
from maskwright.operators import accuracy as acc
from maskwright.operators import history, paired, paths
from maskwright.operators import tokens as tok
from maskwright.sources import corpus, evaluation

# ---- statistics ------------------------------------------------------------

# 48 pairs with the published numbers of non-zero deltas
PUBLISHED = {
    "correctness": [1], "completeness": [-1, -1, -2, -2, -3, -3], "consistency": [], "usefulness": [-1, -1, -1, -1, -2, -2, -4],
}


@pytest.fixture(scope="module")
def deltas(spark):
    rows = []
    for i in range(48):
        values = [(PUBLISHED[d] + [0] * 48)[i] for d in fv.DIMENSIONS]
        rows.append((fv.LANGUAGES[i % 9], f"f{i}", fv.TASKS[i % 6], *values))
    return spark.createDataFrame(rows, "language string, file string, task string, " + ", ".join(f"delta_{d} int" for d in fv.DIMENSIONS))


def test_published_inference(deltas):
    got = {r.dimension: r for r in paired.inference(deltas).collect()}
    want = {  # non-zero, mean, statistic, p, adjusted p, effect
        "correctness": (1, 0.020833, 0.0, 0.317311, 0.317311, 1.0),
        "completeness": (6, -0.25, 0.0, 0.026434, 0.052869, -1.0),
        "usefulness": (7, -0.25, 0.0, 0.015764, 0.047292, -1.0),
    }
    for name, (nonzero, mean, statistic, p, adjusted, effect) in want.items():
        r = got[name]
        assert (r.n_nonzero, round(r.mean, 6), r.statistic, round(r.p_value, 6), round(r.holm_p, 6), r.effect) == (
            nonzero, mean, statistic, p, adjusted, effect,
        )
        assert (r.ci_lower, r.ci_upper, r.median) == (0.0, 0.0, 0.0)
    assert got["consistency"].p_value is None and got["consistency"].holm_p is None and got["consistency"].n_pairs == 48
    assert got["usefulness"].significant and not got["completeness"].significant


@pytest.mark.parametrize("values, p", [([1], 1.0), ([-1, -2], 0.5), ([-1, -1, -2], 0.25), ([1, 2, 2, 3], 0.125), ([1, -2, 3], 0.75)])
def test_exact_test_for_few_pairs(spark, values, p):
    counts = spark.createDataFrame([(1, "d", v) for v in values + [0] * 5], "x int, dimension string, delta int").groupBy("dimension", "delta").agg(F.count("x").alias("n"))
    assert paired.wilcoxon(counts).first().p_value == pytest.approx(p)


@pytest.mark.parametrize("seed", range(4))
def test_exact_test_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 13))
    sizes, ties = np.unique(rng.integers(1, 4, n), return_counts=True)
    ranks = np.cumsum(ties) - (ties - 1) / 2
    signs = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    sums = signs @ np.repeat(ranks, ties)
    for statistic in np.unique(np.minimum(sums, sums.max() - sums)):
        given = pd.Series([[{"rank": int(2 * r), "ties": int(t)} for r, t in zip(ranks, ties)]])
        assert paired.exact_two_sided.func(given, pd.Series([statistic]))[0] == pytest.approx(min(1, 2 * (sums <= statistic).mean()))


def test_exact_test_of_many_pairs_is_fast(spark):
    """500 pairs: no cap, close to the normal law, and for one sign only it is 2 / 2**n."""
    start = time.time()
    given = pd.Series([[{"rank": 2 * i, "ties": 1} for i in range(1, 501)]])
    statistic = 500 * 501 / 4 - 1.96 * np.sqrt(500 * 501 * 1001 / 24)
    assert paired.exact_two_sided.func(given, pd.Series([statistic]))[0] == pytest.approx(0.05, abs=0.001)
    assert paired.exact_two_sided.func(given, pd.Series([0.0]))[0] == pytest.approx(2 / 2.0**500)
    assert time.time() - start < 1
    counts = spark.createDataFrame([("d", 1, 30), ("d", -1, 10)], "dimension string, delta int, n bigint")
    below = sum(math.comb(40, i) for i in range(11)) / 2**40
    assert paired.wilcoxon(counts, method="exact").first().p_value == pytest.approx(2 * below)


@pytest.mark.parametrize("sample", [[-1, 0, 0, 2], [-1, 0, 2], [0, 0, 1, 1, 3, 3], [5]])
def test_law_of_the_median_equals_enumeration(sample):
    values, counts = np.unique(sample, return_counts=True)
    law = paired.median_law(values.tolist(), np.cumsum(counts).tolist())
    medians = [float(np.median(x)) for x in itertools.product(sample, repeat=len(sample))]
    got, before = collections.Counter(), 0
    for median, upto in law:
        got[median] += (upto - before) / paired.DRAWS
        before = upto
    for median, n in collections.Counter(medians).items():
        assert got[median] == pytest.approx(n / len(medians), abs=1e-8)


@pytest.mark.parametrize("n", [2_000, 2_600, 30_000, 1_000_000])
def test_law_of_the_median_of_many_pairs(n):
    """Medians between two deltas too: the k-th number lies below the step, the next one
    above it, which is one term of a binomial law."""
    def halves(share):
        k = n // 2
        return math.exp(math.lgamma(n + 1) - 2 * math.lgamma(k + 1) + k * math.log(share) + k * math.log(1 - share))

    for upto in ([n // 2, n], [n // 2 - n // 1000, n // 2 + n // 1000, n], [1, n // 2, n - 1, n]):
        law = paired.median_law(list(range(len(upto))), upto)
        got, before = collections.Counter(), 0
        for median, t in law:
            assert before <= t <= paired.DRAWS
            got[median] += (t - before) / paired.DRAWS
            before = t
        assert before == paired.DRAWS
        if n // 2 in upto:
            edge = upto.index(n // 2)
            assert sum(p for m, p in got.items() if edge < m < edge + 1) == pytest.approx(halves(0.5), abs=1e-6)


def test_bootstrap_draws_of_many_pairs(spark):
    """two halves of 2,600 pairs, so that many resamples have a median between."""
    counts = spark.createDataFrame([("correctness", -1, 1300), ("correctness", 1, 1300)], "dimension string, delta int, n bigint")
    got = collections.Counter(r["median"] for r in paired.bootstrap_medians(counts, resamples=4000).collect())
    share = math.exp(math.lgamma(2601) - 2 * math.lgamma(1301) - 2600 * math.log(2))
    assert set(got) == {-1.0, 0.0, 1.0} and sum(got.values()) == 4000
    assert abs(got[0.0] / 4000 - share) < 4 * math.sqrt(share / 4000) and abs(got[-1.0] - got[1.0]) < 4 * math.sqrt(4000)


def test_bootstrap_interval_of_many_pairs(spark):
    """more copies of the sample do not change a median that is far from the edges of its step."""
    counts = spark.createDataFrame([("usefulness", d, n * 1000) for d, n in ((-1, 1), (0, 6), (1, 3))], "dimension string, delta int, n bigint")
    assert tuple(paired.bootstrap_median(counts, resamples=500).first()) == ("usefulness", 10_000, 0.0, 0.0)


def test_inference_of_many_pairs(spark):
    """the whole table, with medians that lie between two deltas."""
    delta = [f"cast(if(id % 2 = 0, -1, 1) as int) as delta_{d}" for d in paired.DIMS]
    deltas = spark.range(2600).selectExpr("'go' as language", "concat('f', id) as file", "'t' as task", *delta)
    for r in paired.inference(deltas).collect():
        assert (r.n_pairs, r.n_nonzero, r.median, r["mean"], r.ci_lower, r.ci_upper) == (2600, 2600, 0.0, 0.0, -1.0, 1.0)


def test_pairs_without_a_delta(spark):
    """they count as pairs and stand last; the mean is that of the others."""
    assert paired.median_law([0, None], [1, 2])[-1] == (None, paired.DRAWS)
    for n in (39, 40):
        counts = spark.createDataFrame([("usefulness", -1, n - 10), ("usefulness", 1, 7), ("usefulness", None, 3), ("consistency", None, 5)], "dimension string, delta int, n bigint")
        shifted = counts.where("dimension = 'usefulness'").fillna({"delta": 1}).groupBy("dimension", "delta").agg(F.sum("n").alias("n"))
        draws = paired.bootstrap_medians(counts, resamples=500)
        got = [r["median"] for r in draws.where("dimension = 'usefulness'").orderBy("rep").collect()]
        want = [r["median"] for r in paired.bootstrap_medians(shifted, resamples=500).orderBy("rep").collect()]
        assert got == want
        assert {tuple(r) for r in paired.bootstrap_median(counts, resamples=500).collect()} == {("usefulness", n, -1.0, -1.0), ("consistency", 5, None, None)}
    delta = [f"cast({'null' if d == 'consistency' else 'if(id < 4, null, if(id % 4 = 0, 2, -1))'} as int) as delta_{d}" for d in paired.DIMS]
    found = {r.dimension: r for r in paired.inference(spark.range(44).selectExpr("'go' as language", "concat('f', id) as file", "'t' as task", *delta)).collect()}
    assert (found["usefulness"].n_pairs, found["usefulness"].n_nonzero, found["usefulness"]["mean"]) == (44, 40, -0.25)
    assert (found["consistency"].n_pairs, found["consistency"].n_nonzero, found["consistency"]["mean"], found["consistency"].ci_lower) == (44, 0, None, None)


def test_draws_are_even(spark):
    rows = spark.range(20_000).selectExpr(f"{paired.random_draw(42, '3L', 'id')} as x").collect()
    bins = np.bincount([r.x * 20 // paired.DRAWS for r in rows], minlength=20)
    assert ((bins - 1000) ** 2 / 1000).sum() < 45 and len({r.x for r in rows}) > 19_990


def test_bootstrap_equals_drawing_pair_by_pair(spark):
    values = np.array([-3] * 4 + [-1] * 9 + [0] * 3 + [1] * 15 + [2] * 2)
    for sample in (values, values[:-1]):
        counts = spark.createDataFrame([("correctness", int(v)) for v in sample], "dimension string, delta int").groupBy("dimension", "delta").count().withColumnRenamed("count", "n")
        got = paired.bootstrap_median(counts, resamples=4000).first()
        rng = np.random.default_rng(1)
        medians = [np.median(rng.choice(sample, len(sample))) for _ in range(4000)]
        assert (got.ci_lower, got.ci_upper) == tuple(np.percentile(medians, [2.5, 97.5]))


# ---- tokens ----------------------------------------------------------------


def test_numbering_spans_partitions_and_hot_tokens_join(spark):
    # one value fills a third of all uses, in one category
    uses = spark.range(3000).selectExpr(
        "if(id % 2 = 0, 'URL', 'PASSWORD') as category", "concat('p', id) as path", "cast(id as int) as line",
        "if(id % 3 = 0, 'hot', concat('v', id div 4)) as mark", "named_struct('walk', lpad(id, 6, '0'), 'line', 1) as place",
    ).repartition(5)
    numbers = tok.number_tokens(uses)
    rows = numbers.collect()
    order = {}
    for r in uses.orderBy("place").collect():
        order.setdefault(r.category, {}).setdefault(r.mark, len(order[r.category]) + 1)
    assert {(r.category, r.mark): r.n for r in rows} == {(c, m): n for c, d in order.items() for m, n in d.items()}
    assigned = tok.assign_tokens(uses, numbers, "category", "mark")
    assert assigned.count() == 3000 and assigned.where("n is null").count() == 0
    assert assigned.where("mark = 'hot'").select("category", "token").distinct().count() == 2


# ---- paths -----------------------------------------------------------------


def test_exclusions_cover_directories_but_not_name_prefixes(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b/x", "a/bc/x", "a/y", "top", "q/b/x")], "path string")
    out = paths.exclude(files, spark.createDataFrame([("a/b",), ("top",)], "path string"))
    assert {r.path for r in out.collect()} == {"a/bc/x", "a/y", "q/b/x"}


def test_walk_order_is_files_before_directories(spark):
    names = ["z.txt", "a/z.txt", "a/b/c.txt", "a/b.txt", "a-b/x", "B/x"]
    got = spark.createDataFrame([(n,) for n in names], "path string").selectExpr("path", f"{paths.walk_key('path')} as k").orderBy("k")
    assert [r.path for r in got.collect()] == ["z.txt", "B/x", "a/b.txt", "a/z.txt", "a/b/c.txt", "a-b/x"]


def test_collapsing_exclusions(spark):
    checked = {"a/b/x": False, "a/b/y": False, "a/z": True, "c/d/x": False, "c/y": False, "top": False, "e": True}
    rows = spark.createDataFrame(list(checked.items()), "path string, checked boolean")
    assert {r.path for r in paths.collapse_exclusions(rows).collect()} == {"a/b", "c", "top"}
    nothing = rows.withColumn("checked", F.lit(False))
    assert [r.path for r in paths.collapse_exclusions(nothing).collect()] == [""]


def test_only_changed_needs_a_baseline(spark):
    files = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, hash string")
    with pytest.raises(ValueError):
        paths.only_changed(files, None)
    assert paths.only_changed(files, files).count() == 0


# ---- sources ---------------------------------------------------------------


def test_bytes_decode_like_ignoring_errors(spark):
    samples = [b"plain\r\nx\ry", b"\xff\xfea\xc3", "é�﷐b".encode() + b"\xe2\x82A", b"\xed\xa0\x80z", b""]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(samples)], "i int, content binary")
    got = [r.text for r in corpus.decode_text(rows).orderBy("i").collect()]
    assert got == [b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for b in samples]


def test_lines_and_back(spark, files):
    texts = {"a": "x\n\ny", "b": "x\ny\n", "c": "", "d": "\n"}
    lines = corpus.explode_lines(files(texts))
    counts = {r["path"]: r["count"] for r in lines.groupBy("path").count().collect()}
    assert counts == {"a": 3, "b": 2, "d": 1}
    back = {r.path: r.text for r in corpus.rebuild(lines).collect()}
    assert back == {p: t for p, t in texts.items() if t}


def test_cases_with_problems(spark):
    raw = spark.createDataFrame([(x,) for x in (
        "# note", "", '{"id":"a","file":"f","language":"go","file_type":".go","category":"c","expected_detection":true}',
        '{"id":"b","file":"f"}', "{broken", *['{"id":"d","file":"f","language":"go","file_type":".go","category":"c","expected_detection":false}'] * 2,
    )], "value string")
    cases, rejects = evaluation.parse_cases(raw)
    assert [(r.id, r.expected_sanitization, r.notes, r.line) for r in cases.collect()] == [("a", True, "", None)]
    assert sorted(r.reason.split("_")[0] for r in rejects.collect()) == ["duplicate", "duplicate", "invalid", "missing"]


# ---- accuracy --------------------------------------------------------------


def test_metrics_are_null_without_a_denominator(spark):
    empty = spark.createDataFrame([("TN",)], "outcome string")
    r = acc.prf(empty).first()
    assert (r.tp, r.tn, r.precision, r.recall, r.f1, r.false_positive_rate) == (0, 1, None, None, None, 0.0)


@pytest.mark.parametrize("text, good", [
    ("f(a[1], '}')", True), ("f(a[1)", False), ('x = "a\\"b"', True), ('x = "a', False), ("}", False), ("a\\'b'", True), ('"\\\\" + "x"', True), ("(]", False),
])
def test_balance(spark, text, good):
    row = spark.createDataFrame([("a.java", text)], "path string, text string")
    assert acc.check_format(row).first().status == ("heuristic_valid" if good else "heuristic_invalid")


def test_format_of_json_and_xml(spark):
    rows = spark.createDataFrame([
        ("a.json", '{"a": 1}'), ("b.json", '{"a": '), ("a.xml", "<a><b>&lt;X_1&gt;</b></a>"), ("b.xml", "<a><b><X_1></b></a>"), ("c.yaml", "a: ["),
    ], "path string, text string")
    assert [r.status for r in acc.check_format(rows).orderBy("path").collect()] == ["valid", "valid", "invalid", "invalid", "not_applicable"]


def test_format_is_what_a_parser_says(spark):
    big = '{"a": "' + "x" * (20 << 20) + '"}'
    rows = {
        "a.json": '{"a":1} x', "b.json": '{"a":1,"a":2}', "c.json": "[NaN]", "d.json": big, "e.json": "", "f.json": "[" * 100_000,
        "a.xml": "<a/><b/>", "b.xml": "<a/> x", "c.config": "<?xml version='1.0'?><a/>", "d.xml": None,
    }
    got = acc.check_format(spark.createDataFrame(list(rows.items()), "path string, text string")).collect()
    assert {r.path for r in got if r.status == "valid"} == {"b.json", "c.json", "d.json", "c.config"}
    assert {r.status for r in got} == {"valid", "invalid"}


def test_counts_of_many_conditions(spark):
    scores = spark.createDataFrame([(f"c{i % 12}",) for i in range(24)], "condition string")
    assert evaluation.assert_counts(scores, 24, 2) is scores
    for wrong in ((25, 2), (24, 3)):
        with pytest.raises(ValueError):
            evaluation.assert_counts(scores, *wrong)


def test_test_method_is_an_argument(spark):
    counts = spark.createDataFrame([("d", 1, 15), ("d", -1, 1)], "dimension string, delta int, n bigint")
    p = {m: paired.wilcoxon(counts, method=m).first().p_value for m in ("published", "normal", "exact")}
    assert p["published"] == p["normal"] != p["exact"] == pytest.approx(2 * 17 / 2**16)


def test_unscanned_paths_stay_rows(spark):
    rows = spark.createDataFrame([("a", "unscanned", "binary"), ("b", "unscanned", "binary"), ("c", "scanned", None)], "path string, status string, reason string")
    assert sorted(tuple(r) for r in history.unscanned_by_reason(rows).collect()) == [("binary", "a", 2), ("binary", "b", 2)]

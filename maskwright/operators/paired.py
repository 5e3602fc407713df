"""Paired evaluation: the same task answered under two conditions.

Scores are small integers, so each statistic is computed from the number of
pairs per delta.  That histogram has a handful of rows per dimension however many
pairs there are, and building it combines on the map side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..functions.text import Sql, let, q

PAIR_KEYS = ("language", "file", "task")
DIMS = tuple(fv.DIMENSIONS)


# ---- pairs and deltas ------------------------------------------------------


def _pairs(scores: DataFrame) -> DataFrame:
    columns = [
        F.max(F.when(F.col("condition") == c, F.col(d))).alias(f"{c}_{d}") for d in DIMS for c in ("original", "sanitized")
    ]
    return scores.groupBy(*PAIR_KEYS).agg(
        F.count_if(F.col("condition") == "original").alias("n_original"),
        F.count_if(F.col("condition") == "sanitized").alias("n_sanitized"),
        *columns,
    )


def pair_deltas(scores: DataFrame) -> DataFrame:
    """Both scores and their difference (sanitized - original) per complete pair."""
    columns = [c for d in DIMS for c in (f"original_{d}", f"sanitized_{d}", f"sanitized_{d} - original_{d} as delta_{d}")]
    return _pairs(scores).where("n_original > 0 and n_sanitized > 0").selectExpr(*PAIR_KEYS, *columns)


def incomplete_pairs(scores: DataFrame) -> DataFrame:
    return _pairs(scores).where("n_original = 0 or n_sanitized = 0").select(*PAIR_KEYS, "n_original", "n_sanitized")


def delta_mismatch(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Pairs and dimensions whose stored delta differs from the recomputed one, or
    that only one side has."""
    a = deltas_long(stored).withColumnRenamed("delta", "stored")
    b = deltas_long(recomputed).withColumnRenamed("delta", "recomputed")
    return a.join(b, [*PAIR_KEYS, "dimension"], "full").where("not (stored <=> recomputed)")


def _stack(names: list[str], sources: list[str], value: str) -> str:
    return f"stack({len(names)}, " + ", ".join(f"'{n}', {s}" for n, s in zip(names, sources)) + f") as (dimension, {value})"


def deltas_long(deltas: DataFrame) -> DataFrame:
    return deltas.selectExpr(*PAIR_KEYS, _stack(list(DIMS), [f"delta_{d}" for d in DIMS], "delta"))


def scores_long(scores: DataFrame) -> DataFrame:
    return scores.selectExpr(*PAIR_KEYS, "condition", _stack(list(DIMS), list(DIMS), "score"))


# ---- descriptive tables ----------------------------------------------------


def _describe(counts: DataFrame, by: list[str], value: str, *more) -> DataFrame:
    """Statistics from (value, n); the median uses n as a frequency."""
    return (
        counts.groupBy(*by).agg(
            F.sum("n").alias("n_values"), F.sum(F.col(value) * F.col("n")).alias("s1"),
            F.sum(F.col(value) * F.col(value) * F.col("n")).alias("s2"),
            F.expr(f"percentile({value}, 0.5, n)").alias("median"),
            F.min(value).alias("min"), F.max(value).alias("max"), *more,
        )
        .withColumn("mean", F.expr("s1 / n_values"))
        .withColumn("sd", F.expr("if(n_values > 1, sqrt((s2 - s1 * s1 / n_values) / (n_values - 1)), null)"))
        .drop("s1", "s2")
    )


def describe_scores(scores: DataFrame) -> DataFrame:
    """n, mean, median, sample sd, min, max per dimension and condition."""
    by = ["dimension", "condition"]
    return _describe(scores_long(scores).groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n")), by, "score")


def delta_counts(deltas: DataFrame, *by: str) -> DataFrame:
    """(by..., dimension, delta, n): the histogram all tests work on."""
    return deltas_long(deltas).groupBy(*by, "dimension", "delta").agg(F.count(F.lit(1)).alias("n"))


def describe_deltas(deltas: DataFrame, *by: str) -> DataFrame:
    """Improved / unchanged / decreased and the usual statistics per dimension."""
    split = [
        F.sum(F.expr(f"if({test}, n, 0)")).alias(name)
        for name, test in (("improved", "delta > 0"), ("unchanged", "delta = 0"), ("decreased", "delta < 0"))
    ]
    return _describe(delta_counts(deltas, *by), [*by, "dimension"], "delta", *split)


def distribution(counts: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """(dimension, value, n) with a row for every value from low to high."""
    grid = counts.sparkSession.range(1).selectExpr(
        "explode(array(" + ", ".join(f"'{d}'" for d in DIMS) + ")) as dimension"
    ).selectExpr("dimension", f"explode(sequence({low}, {high})) as {value}")
    return grid.join(counts, ["dimension", value], "left").select("dimension", value, F.coalesce("n", F.lit(0)).alias("n"))


# ---- signed-rank test ------------------------------------------------------


def rank_table(counts: DataFrame, *by: str) -> DataFrame:
    """Average rank of each absolute non-zero delta: (by..., dimension, size, ties,
    avg_rank).  At most one row per possible size in each window."""
    keys = [*by, "dimension"]
    sizes = counts.where("delta <> 0").selectExpr(*keys, "abs(delta) as size", "n").groupBy(*keys, "size").agg(F.sum("n").alias("ties"))
    upto = Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("avg_rank", F.sum("ties").over(upto) - (F.col("ties") - 1) / 2)


def signed_ranks(deltas: DataFrame) -> DataFrame:
    """Signed average rank of every non-zero delta."""
    ranks = rank_table(delta_counts(deltas)).select("dimension", "size", "avg_rank")
    # a few rows per dimension
    return (
        deltas_long(deltas).where("delta <> 0").withColumn("size", F.abs("delta"))
        .join(F.broadcast(ranks), ["dimension", "size"])
        .selectExpr(*PAIR_KEYS, "dimension", "delta", "signum(delta) * avg_rank as signed_rank")
    )


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) for a standard normal Z; runs on one row per test."""
    return z.map(lambda x: None if x is None or np.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def exact_two_sided(sizes: pd.Series, statistic: pd.Series) -> pd.Series:
    """P(the smaller rank sum is at most ``statistic``) over all sign assignments; runs on
    one row per test.  ``sizes`` has the doubled ranks, which are whole, with their ties.

    The law of the rank sum is built rank by rank: with each, half of the probability
    moves up by it.  Only sums up to the statistic count, so that is all that is kept."""

    def p(sizes, statistic):
        if sizes is None or statistic is None or np.isnan(statistic):
            return None
        law = np.zeros(round(2 * statistic) + 1)
        law[0] = 1.0
        for size in sizes:
            rank = int(size["rank"])
            for _ in range(int(size["ties"])):
                moved = law[: max(0, len(law) - rank)] / 2
                law /= 2
                law[rank:] += moved
        return min(1.0, 2 * float(law.sum()))

    return pd.Series([p(*x) for x in zip(sizes, statistic)], dtype="object").astype("Float64")


def wilcoxon(counts: DataFrame, *by: str, method: str = "published") -> DataFrame:
    """W+, W-, statistic, z, p and rank-biserial effect from a delta histogram.

    Zeros are dropped; ties get average ranks and correct the variance; there is
    no continuity correction.  ``method`` is ``normal``, ``exact`` (over all sign
    assignments; time grows with the cube of the number of non-zero pairs) or
    ``published``, the rule of the published analysis: exact up to 13 pairs, else normal.
    Without a non-zero delta the test is degenerate: null.
    """
    exact = {"published": f"n_pairs <= {fv.EXACT_TEST_MAX_PAIRS}", "exact": "true", "normal": "false"}[method]
    keys = [*by, "dimension"]
    ranks = rank_table(counts, *by)
    signed = counts.where("delta <> 0").withColumn("size", F.abs("delta")).join(ranks, [*keys, "size"])
    sums = signed.groupBy(*keys).agg(
        F.sum(F.expr("if(delta > 0, n * avg_rank, 0D)")).alias("w_plus"),
        F.sum(F.expr("if(delta < 0, n * avg_rank, 0D)")).alias("w_minus"),
        F.sum("n").alias("n_nonzero"),
    )
    ties = ranks.groupBy(*keys).agg(
        F.sum(F.expr("cast(ties as double) * ties * ties - ties")).alias("tie_term"),
        # one entry per size of a delta
        F.array_sort(F.collect_list(F.expr("named_struct('rank', cast(2 * avg_rank as bigint), 'ties', ties)"))).alias("sizes"),
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n_pairs"))
    return (
        totals.join(sums, keys, "left").join(ties, keys, "left")
        .withColumn("statistic", F.expr("least(w_plus, w_minus)"))
        .withColumn("sd", F.expr("sqrt((cast(n_nonzero as double) * (n_nonzero + 1) * (2 * n_nonzero + 1) - tie_term / 2) / 24)"))
        .withColumn("z", F.expr("(statistic - cast(n_nonzero as double) * (n_nonzero + 1) / 4) / sd"))
        .withColumn("p_normal", normal_two_sided("z"))
        .withColumn("p_exact", exact_two_sided(F.expr(f"if({exact}, sizes, null)"), "statistic"))
        .withColumn("p_value", F.expr(f"if({exact}, p_exact, p_normal)"))
        .withColumn("effect", rank_biserial())
        .withColumn("n_nonzero", F.coalesce("n_nonzero", F.lit(0)))
        .select(*keys, "n_pairs", "n_nonzero", "w_plus", "w_minus", "statistic", "z", "p_value", "effect")
    )


def rank_biserial():
    return F.expr("try_divide(w_plus - w_minus, w_plus + w_minus)")


def holm(tests: DataFrame, *family: str) -> DataFrame:
    """Step-down adjusted p-values; tests without p stay out of the family.  A
    family is a handful of tests."""
    by = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = by.orderBy("p_value", "dimension")
    valid = (
        tests.where("p_value is not null")
        .withColumn("m", F.count(F.lit(1)).over(by)).withColumn("i", F.row_number().over(order))
        .withColumn("raw", F.expr("(m - i + 1) * p_value"))
        .withColumn("holm_p", F.least(F.lit(1.0), F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
        .drop("m", "i", "raw")
    )
    return valid.unionByName(tests.where("p_value is null").withColumn("holm_p", F.lit(None).cast("double")))


# ---- bootstrap -------------------------------------------------------------


#: Random numbers are remainders modulo this prime.
DRAWS = 2147483647


def random_draw(seed: int, stream: Sql, counter: Sql) -> Sql:
    """A whole number below ``DRAWS`` that only depends on the three, by integer
    arithmetic that stays below 2**63 and so is the same in every engine."""
    x = f"(({seed} * 1000003 + {stream} * 7919 + {counter} * 48271L + 12345) % {DRAWS})"
    for shift, factor in ((16, 48271), (13, 69621), (15, 16807)):
        x = let(x, lambda v: f"((({v} ^ shiftright({v}, {shift})) * {factor}L) % {DRAWS})")
    return x


def _tail(n: int, k: int, share: float) -> float:
    """P(at least k of n uniform numbers lie below ``share``)."""
    if share <= 0 or share >= 1:
        return float(share >= 1)
    reach = 40 * math.sqrt(n) + 40  # terms beyond are nothing
    low, high = max(k, math.floor(n * share - reach)), min(n, math.ceil(n * share + reach))
    whole, a, b = math.lgamma(n + 1), math.log(share), math.log1p(-share)
    return min(1.0, math.fsum(math.exp(whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * a + (n - i) * b) for i in range(low, high + 1)))


def median_law(deltas: list[int | None], upto: list[int]) -> list[tuple[float | None, int]]:
    """The medians that a resample of the pairs can have, each with the number that a
    draw must not exceed.  ``upto`` counts the pairs at or below each delta.  Pairs
    without a delta come last, as one that is larger than all others; a draw between it
    and another takes the next median.

    The median of n resampled pairs is the delta at the middle order statistic of n
    uniform numbers (for even n, the mean of two), so its law is a binomial one."""
    n, share = upto[-1], [0.0, *(u / upto[-1] for u in upto)]
    k, m = (n + 1) // 2, len(deltas)
    tails = [_tail(n, k, x) for x in share]
    # powers for themselves are out of a double's range from some thousand pairs on, so only their logarithms meet
    power = lambda x: k * math.log(x) if x > 0 else -math.inf
    below, above = [power(x) for x in share], [power(1 - x) for x in share]
    ways = math.lgamma(n + 1) - 2 * math.lgamma(k + 1)
    law, total = [], 0.0
    for i in range(m):
        apart = []
        if n % 2 == 0:
            # the k-th number in step i, the next one in step j
            here = -math.expm1(below[i] - below[i + 1])
            apart = [math.exp(ways + below[i + 1] + above[j]) * here * -math.expm1(above[j + 1] - above[j]) for j in range(i + 1, m)]
        same = max(0.0, tails[i + 1] - tails[i] - math.fsum(apart))
        for j, p in zip(range(i, m), [same, *apart]):
            total += p
            if deltas[j] is not None:
                law.append(((deltas[i] + deltas[j]) / 2, math.floor(total * DRAWS)))
    if deltas[-1] is None:
        law.append((None, DRAWS))
    law[-1] = (law[-1][0], DRAWS)
    return law


@F.pandas_udf(ArrayType(StructType([StructField("median", DoubleType()), StructField("upto", LongType())])))
def _median_laws(steps: pd.Series) -> pd.Series:
    """One row per dimension."""
    laws = [median_law([None if x["delta"] is None else int(x["delta"]) for x in s], [int(x["upto"]) for x in s]) for s in steps]
    return pd.Series([[{"median": m, "upto": t} for m, t in law] for law in laws])


def bootstrap_medians(counts: DataFrame, resamples: int = fv.BOOTSTRAP_RESAMPLES, seed: int = fv.BOOTSTRAP_SEED) -> DataFrame:
    """(dimension, n_pairs, rep, median): the median of every resample.

    A resample of n pairs need not be drawn pair by pair: a draw picks one of the few
    medians that are possible, with its exact probability, whatever n is.
    """
    upto = Window.partitionBy("dimension").orderBy(F.asc_nulls_last("delta")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per dimension with its few values and their cumulated counts
    table = (
        counts.withColumn("upto", F.sum("n").over(upto)).groupBy("dimension")
        .agg(F.array_sort(F.collect_list(F.struct("upto", "delta"))).alias("steps"), F.sum("n").alias("n_pairs"))
        .withColumn("law", _median_laws("steps"))
    )
    stream = f"cast(coalesce(array_position(array({', '.join(q(d) for d in DIMS)}), dimension), 0) as bigint)"
    draws = table.select("dimension", "n_pairs", "law", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep"))
    return draws.withColumn("draw", F.expr(random_draw(seed, stream, "rep"))).selectExpr(
        "dimension", "n_pairs", "rep", "element_at(filter(law, l -> l.upto >= draw), 1).median as median"
    )


def bootstrap_median(
    counts: DataFrame, resamples: int = fv.BOOTSTRAP_RESAMPLES, seed: int = fv.BOOTSTRAP_SEED, alpha: float = fv.ALPHA
) -> DataFrame:
    """Percentile interval of the median over seeded resamples of the pairs that have a
    delta; those without one count in ``n_pairs`` only."""
    intervals = bootstrap_medians(counts.where("delta is not null"), resamples, seed).groupBy("dimension").agg(
        F.expr(f"percentile(median, {alpha / 2})").alias("ci_lower"),
        F.expr(f"percentile(median, {1 - alpha / 2})").alias("ci_upper"),
    )
    return counts.groupBy("dimension").agg(F.sum("n").alias("n_pairs")).join(intervals, "dimension", "left")


# ---- the whole analysis ----------------------------------------------------


def inference(deltas: DataFrame) -> DataFrame:
    """Confirmatory table: test, adjusted p, effect, interval per dimension."""
    counts = delta_counts(deltas)
    tests = holm(wilcoxon(counts))
    shape = _describe(counts.where("delta is not null"), ["dimension"], "delta").select("dimension", "median", "mean")
    interval = bootstrap_median(counts).drop("n_pairs")
    return (
        tests.join(F.broadcast(shape), "dimension", "left").join(F.broadcast(interval), "dimension")
        .withColumn("significant", F.col("holm_p") < fv.ALPHA)
    )


def by_group(deltas: DataFrame, column: str, min_pairs: int = 5) -> DataFrame:
    """Exploratory table per task or language.  A test needs at least one non-zero
    delta and five pairs."""
    shape = describe_deltas(deltas, column).selectExpr(column, "dimension", "n_values as n_pairs", "mean", "median")
    tests = wilcoxon(delta_counts(deltas, column), column).select(column, "dimension", "n_nonzero", "statistic", "p_value")
    tested = f"n_nonzero >= 1 and n_pairs >= {min_pairs}"
    return shape.join(tests, [column, "dimension"]).withColumns({
        "statistic": F.expr(f"if({tested}, statistic, null)"), "p_value": F.expr(f"if({tested}, p_value, null)"),
    })


def control_changes(deltas: DataFrame, language: str = fv.CONTROL_LANGUAGE) -> DataFrame:
    """Pairs of the control language, whose two inputs are identical, with the
    dimensions that changed all the same."""
    changed = "array_compact(array(" + ", ".join(f"if(delta_{d} <> 0, '{d}', null)" for d in DIMS) + "))"
    return deltas.where(F.col("language") == language).selectExpr(
        *PAIR_KEYS, f"{changed} as dims"
    ).selectExpr(*PAIR_KEYS, "array_join(dims, ';') as changed_dimensions", "size(dims) > 0 as changed")


def deviating_pairs(scores: DataFrame, tag: str = fv.DEVIATION_TAG) -> DataFrame:
    return scores.where(F.array_contains("tags", tag)).select(*PAIR_KEYS).distinct()


def without_deviating(deltas: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs of which no response deviated from the protocol."""
    return deltas.join(deviating_pairs(scores), list(PAIR_KEYS), "left_anti")


def sensitivity(deltas: DataFrame, scores: DataFrame) -> DataFrame:
    """The confirmatory table again, on the pairs without deviations."""
    return inference(without_deviating(deltas, scores))


# ---- integrity -------------------------------------------------------------


def tag_counts(scores: DataFrame) -> DataFrame:
    """How often each failure tag occurs, with the tags that never do.  Tags that
    are not on the list are counted too."""
    seen = scores.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    known = scores.sparkSession.range(1).selectExpr("explode(array(" + ", ".join(f"'{t}'" for t in fv.FAILURE_TAGS) + ")) as tag")
    return known.join(seen, "tag", "full").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def coverage_matrix(scores: DataFrame) -> DataFrame:
    """Cells of the grid file x task x condition that are missing or filled more
    than once.  Tasks for configuration files do not apply to others."""
    tasks = "array(" + ", ".join(f"'{t}'" for t in fv.TASKS) + ")"
    config = "(" + ", ".join(f"'{x}'" for x in fv.CONFIG_LANGUAGES) + ")"
    expected = (
        scores.select("language", "file").distinct()
        .selectExpr("language", "file", f"explode({tasks}) as task")
        .where(f"task <> '{fv.CONFIG_ONLY_TASK}' or language in {config}")
        .selectExpr("language", "file", "task", "explode(array('original', 'sanitized')) as condition")
    )
    cell = [*PAIR_KEYS, "condition"]
    present = scores.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    return (
        expected.withColumn("wanted", F.lit(True)).join(present, cell, "full")
        .withColumn("problem", F.expr(
            "case when n is null then 'missing' when wanted is null then 'not_applicable' when n > 1 then 'duplicate' end"
        ))
        .where("problem is not null").select(*cell, "problem")
    )


def invalid_scores(scores: DataFrame) -> DataFrame:
    """Rows that break a scoring rule, with the rule: the four dimensions are
    always 1 to 5; the placeholder question applies to sanitized input only; the
    relationship question only to the task that asks for relationships."""
    checks = [f"if({d} is null or {d} not between 1 and 5, '{d}', null)" for d in DIMS]
    checks.append(
        "if((condition = 'original') <> (misunderstood_value is null) or misunderstood_value not between 1 and 5,"
        " 'misunderstood_value', null)"
    )
    checks.append(
        f"if((task <> '{fv.CONFIG_ONLY_TASK}') <> (relationships_preserved is null)"
        " or relationships_preserved not between 1 and 5, 'relationships_preserved', null)"
    )
    return (
        scores.withColumn("rule", F.explode(F.expr(f"array_compact(array({', '.join(checks)}))")))
        .select(*PAIR_KEYS, "condition", "rule")
    )


def keyword_sweep(texts: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(word, n_texts, n_hits) over a text column, in one pass for all words."""
    words = words or fv.SWEEP_WORDS
    count = lambda w: f"(length(low) - length(replace(low, {q(w)}, ''))) div {len(w)}"
    entries = ", ".join(f"{q(w)}, {count(w)}" for w in words)
    found = texts.selectExpr("lower(text) as low").selectExpr(f"stack({len(words)}, {entries}) as (word, hits)")
    return found.groupBy("word").agg(F.count_if(F.col("hits") > 0).alias("n_texts"), F.sum("hits").alias("n_hits"))

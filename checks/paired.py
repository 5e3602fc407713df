"""Checks of the paired evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright import fixed_values as fv
from maskwright.operators import paired

from . import carriers, duck
from .registry import carrier, query, table

DIMS = fv.DIMENSIONS
KEYS = "language, file, task"
_COLUMNS = ", ".join(
    f"max({d}) filter (condition = '{c}') as {c}_{d}" for d in DIMS for c in ("original", "sanitized")
)
PAIRS = (
    f"(select {KEYS}, count(*) filter (condition = 'original') as n_original, count(*) filter (condition = 'sanitized') as n_sanitized, {_COLUMNS}"
    f" from {duck.SCORES} group by all)"
)
DELTAS = f"(select *, {', '.join(f'sanitized_{d} - original_{d} as delta_{d}' for d in DIMS)} from {PAIRS} where n_original > 0 and n_sanitized > 0)"
LONG = "(" + " union all ".join(f"select {KEYS}, '{d}' as dimension, delta_{d} as delta from {DELTAS}" for d in DIMS) + ")"
SCORES_LONG = "(" + " union all ".join(f"select {KEYS}, condition, '{d}' as dimension, {d} as score from {duck.SCORES}" for d in DIMS) + ")"


def scores(spark, folder):
    tags = "filter(transform(split(failure_modes, ';'), t -> trim(t)), t -> t not in ('', 'none'))"
    return carrier(spark, folder, carriers.SCORES).withColumn("tags", F.expr(tags))


def deltas(spark, folder):
    return paired.pair_deltas(scores(spark, folder))


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


@query("pair_deltas", f"select {KEYS}, {', '.join(f'original_{d}, sanitized_{d}, delta_{d}' for d in DIMS)} from {DELTAS}")
def pair_deltas(spark, folder):
    return deltas(spark, folder)


@query("incomplete_pairs", f"select {KEYS}, n_original, n_sanitized from {PAIRS} where n_original = 0 or n_sanitized = 0")
def incomplete_pairs(spark, folder):
    return paired.incomplete_pairs(scores(spark, folder))


@query(
    "delta_mismatch",
    f"select {KEYS}, dimension, case when length(file) % 2 = 0 and dimension = 'correctness' then delta + 1 else delta end as stored, delta as recomputed"
    f" from {LONG} where length(file) % 2 = 0 and dimension = 'correctness'",
)
def delta_mismatch(spark, folder):
    right = deltas(spark, folder)
    wrong = right.withColumn("delta_correctness", F.expr("delta_correctness + if(length(file) % 2 = 0, 1, 0)"))
    return paired.delta_mismatch(wrong, right)


_STATS = "median({v}) as median, min({v}) as min, max({v}) as max, round(avg({v}), 9) as mean, round(stddev_samp({v}), 9) as sd"


@query("describe_scores", f"select dimension, condition, count(*) as n_values, {_STATS.format(v='score')} from {SCORES_LONG} group by all")
def describe_scores(spark, folder):
    return rounded(paired.describe_scores(scores(spark, folder)), "mean", "sd")


@query(
    "describe_deltas",
    "select dimension, count(*) as n_values, count(*) filter (delta > 0) as improved, count(*) filter (delta = 0) as unchanged,"
    f" count(*) filter (delta < 0) as decreased, {_STATS.format(v='delta')} from {LONG} group by all",
)
def describe_deltas(spark, folder):
    return rounded(paired.describe_deltas(deltas(spark, folder)), "mean", "sd")


_GRID = "(select unnest([" + ", ".join(f"'{d}'" for d in DIMS) + "]) as dimension)"


@query(
    "delta_distribution",
    f"select g.dimension, cast(v.delta as int) as delta, count(l.delta) as n from {_GRID} g cross join (select unnest(range(-4, 5)) as delta) v"
    f" left join {LONG} l on l.dimension = g.dimension and l.delta = v.delta group by all",
)
def delta_distribution(spark, folder):
    return paired.distribution(paired.delta_counts(deltas(spark, folder)), "delta", -4, 4)


@query(
    "score_distribution",
    f"select g.dimension, cast(v.score as int) as score, count(l.score) as n from {_GRID} g cross join (select unnest(range(1, 6)) as score) v"
    f" left join {SCORES_LONG} l on l.dimension = g.dimension and l.score = v.score group by all",
)
def score_distribution(spark, folder):
    counts = paired.scores_long(scores(spark, folder)).groupBy("dimension", "score").agg(F.count(F.lit(1)).alias("n"))
    return paired.distribution(counts, "score", 1, 5)


def ranked(by: str) -> str:
    return (
        f"(select *, rank() over (partition by {by} order by abs(delta)) + (count(*) over (partition by {by}, abs(delta)) - 1) / 2 as r,"
        f" count(*) over (partition by {by}, abs(delta)) as t from {LONG} where delta <> 0)"
    )


@query("signed_ranks", f"select {KEYS}, dimension, delta, sign(delta) * r as signed_rank from {ranked('dimension')}")
def signed_ranks(spark, folder):
    return paired.signed_ranks(deltas(spark, folder))


def tested(by: str) -> str:
    """W+, W-, statistic, z, effect and the normal p (erfc by its series)."""
    sums = (
        f"(select {by}, coalesce(sum(r) filter (delta > 0), 0) as w_plus, coalesce(sum(r) filter (delta < 0), 0) as w_minus, count(*) as m,"
        f" sum(t * t - 1.0) as tie_term, list(r) as rs from {ranked(by)} group by all)"
    )
    z = "(least(w_plus, w_minus) - m * (m + 1) / 4.0) / sqrt((m * (m + 1) * (2.0 * m + 1) - tie_term / 2) / 24)"
    series = "list_sum(list_transform(range(0, 90), lambda k: (case when k % 2 = 0 then 1 else -1 end) * pow(abs(z) / sqrt(2), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))))"
    exact = (
        "least(1, 2 * len(list_filter(range(0, cast(pow(2, m) as bigint)), lambda b: coalesce(list_sum(list_transform(rs, lambda x, i: case when (b >> (i - 1)) & 1 = 1 then x else 0 end)), 0)"
        " <= least(w_plus, w_minus))) / pow(2, m))"
    )
    join = " and ".join(f"a.{c.strip()} = s.{c.strip()}" for c in by.split(","))
    return (
        f"(select *, case when m is null then null when n_pairs <= {fv.EXACT_TEST_MAX_PAIRS} then {exact} else 1 - 2 / sqrt(pi()) * {series} end as p from"
        f" (select a.*, w_plus, w_minus, m, rs, {z} as z, (w_plus - w_minus) / (w_plus + w_minus) as effect from"
        f" (select {by}, count(*) as n_pairs from {LONG} group by all) a left join {sums} s on {join}))"
    )


_TESTED = tested("dimension")


@query(
    "wilcoxon_tests",
    f"select dimension, n_pairs, coalesce(m, 0) as n_nonzero, w_plus, w_minus, least(w_plus, w_minus) as statistic, round(z, 9) as z, round(p, 6) as p_value, round(effect, 9) as effect from {_TESTED}",
)
def wilcoxon_tests(spark, folder):
    return rounded(rounded(paired.wilcoxon(paired.delta_counts(deltas(spark, folder))), "z", "effect"), "p_value", digits=6)


@query("rank_biserial", f"select dimension, round(effect, 9) as effect from {_TESTED}")
def rank_biserial(spark, folder):
    return rounded(paired.wilcoxon(paired.delta_counts(deltas(spark, folder))).select("dimension", "effect"), "effect")


_HOLM = (
    "(select dimension, p, least(1, max((c - i + 1) * p) over (order by i)) as holm_p from (select dimension, p, row_number() over (order by p, dimension) as i,"
    f" count(*) over () as c from {_TESTED} where p is not null))"
)


@query(
    "holm_adjusted",
    f"select t.dimension, round(t.p, 6) as p_value, round(h.holm_p, 6) as holm_p from {_TESTED} t left join {_HOLM} h on h.dimension = t.dimension",
)
def holm_adjusted(spark, folder):
    tests = paired.holm(paired.wilcoxon(paired.delta_counts(deltas(spark, folder))))
    return rounded(tests.select("dimension", "p_value", "holm_p"), "p_value", "holm_p", digits=6)


_X = f"((({fv.BOOTSTRAP_SEED} * 1000003 + stream * 7919 + rep * 48271 + 12345) % {paired.DRAWS})::bigint)"
for _shift, _factor in ((16, 48271), (13, 69621), (15, 16807)):
    _X = f"list_transform([{_X}], lambda v: (xor(v, v >> {_shift}) * {_factor}) % {paired.DRAWS})[1]"
_TAIL = (
    "case when {x} <= 0 then 0 when {x} >= 1 then 1 else list_sum(list_transform(range(k, n + 1), lambda i:"
    " exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({x}) + (n - i) * ln(1 - {x})))) end"
)
_FIRST = "case when {x} <= 0 then 0 else exp(lgamma(a.n + 1) / 2 - lgamma(a.k + 1) + a.k * ln({x})) end"
_MEDIANS = f"""
 hist as (select dimension, delta as v, count(*) as c from {LONG} group by all),
 steps as (select dimension, v, row_number() over w as j, (sum(c) over w)::bigint as upto, (sum(c) over (partition by dimension))::bigint as n from hist window w as (partition by dimension order by v)),
 shares as (select *, (n + 1) // 2 as k, upto / n as hi, coalesce(lag(upto) over (partition by dimension order by j), 0) / n as lo from steps),
 tails as materialized (select *, {_TAIL.format(x='hi')} - {_TAIL.format(x='lo')} as own from shares),
 apart as (select a.dimension, a.j as i, b.j as j, (a.v + b.v) / 2 as median,
   ({_FIRST.format(x='a.hi')} - {_FIRST.format(x='a.lo')}) * ({_FIRST.format(x='(1 - b.lo)')} - {_FIRST.format(x='(1 - b.hi)')}) as p
   from tails a join tails b on b.dimension = a.dimension and b.j > a.j and a.n % 2 = 0),
 law as (select dimension, i, j, median, p from apart union all
   select t.dimension, t.j, t.j, t.v, greatest(0, t.own - coalesce((select sum(p) from apart x where x.dimension = t.dimension and x.i = t.j), 0)) from tails t),
 upto as materialized (select *, case when row_number() over (partition by dimension order by i desc, j desc) = 1 then {paired.DRAWS}
   else floor(sum(p) over (partition by dimension order by i, j) * {paired.DRAWS}) end as t from law),
 draws as (select dimension, n_pairs, rep, {_X} as draw from (select dimension, max(n) as n_pairs, list_position([{', '.join(f"'{d}'" for d in DIMS)}], dimension) as stream from steps group by all),
   range(0, {fv.BOOTSTRAP_RESAMPLES}) r(rep))"""


@query(
    "bootstrap_draws",
    f"with {_MEDIANS} select d.dimension, d.n_pairs, d.rep, min_by(u.median, u.t + u.i / 1000.0 + u.j / 1000000.0) as median"
    " from draws d join upto u on u.dimension = d.dimension and u.t >= d.draw group by all",
)
def bootstrap_draws(spark, folder):
    """The median of every single resample."""
    return paired.bootstrap_medians(paired.delta_counts(deltas(spark, folder))).withColumn("rep", F.col("rep").cast("bigint"))


# Every resample drawn pair by pair; the Spark side draws medians by their law.
_BOOT = f"""(select dimension, max(n) as n_pairs, quantile_cont(med, 0.025) as ci_lower, quantile_cont(med, 0.975) as ci_upper from
 (select d.dimension, d.n, rep, median(d.ds[1 + (cast('0x' || substr(md5(cast(rep as varchar) || '_' || cast(i as varchar) || d.dimension), 1, 8) as bigint) % d.n)]) as med
  from (select dimension, count(*) as n, list(delta order by {KEYS}) as ds from {LONG} group by all) d, range(0, {fv.BOOTSTRAP_RESAMPLES}) r(rep), range(0, (select count(*) from {DELTAS})) s(i)
  group by d.dimension, d.n, rep) group by dimension)"""


@query("bootstrap_median", f"select dimension, n_pairs, ci_lower, ci_upper from {_BOOT}")
def bootstrap_median(spark, folder):
    return paired.bootstrap_median(paired.delta_counts(deltas(spark, folder)))


def _register_group(column):
    sql = tested(f"{column}, dimension")

    @query(
        f"exploratory_by_{column}",
        f"select t.{column}, t.dimension, t.n_pairs, coalesce(m, 0) as n_nonzero, mean, median, case when m >= 1 and t.n_pairs >= 5 then least(w_plus, w_minus) end as statistic,"
        f" case when m >= 1 and t.n_pairs >= 5 then round(p, 6) end as p_value from {sql} t join (select {column}, dimension, round(avg(delta), 9) as mean, median(delta) as median from {LONG} group by all) g"
        f" on g.{column} = t.{column} and g.dimension = t.dimension",
    )
    def run(spark, folder):
        return rounded(rounded(paired.by_group(deltas(spark, folder), column), "mean"), "p_value", digits=6)


for _column in ("task", "language", "file"):
    _register_group(_column)


_CHANGED = "concat_ws(';', " + ", ".join(f"case when delta_{d} <> 0 then '{d}' end" for d in DIMS) + ")"


@query(
    "control_changes",
    f"select {KEYS}, {_CHANGED} as changed_dimensions, {_CHANGED} <> '' as changed from {DELTAS} where language = '{fv.CONTROL_LANGUAGE}'",
)
def control_changes(spark, folder):
    return paired.control_changes(deltas(spark, folder))


_CLEAN = f"(select d.* from {DELTAS} d where not exists (select 1 from {duck.SCORES} s where s.language = d.language and s.file = d.file and s.task = d.task and contains(s.failure_modes, 'environmental_deviation')))"


@query("without_deviating_pairs", f"select {KEYS}, {', '.join(f'delta_{d}' for d in DIMS)} from {_CLEAN}")
def without_deviating_pairs(spark, folder):
    return paired.without_deviating(deltas(spark, folder), scores(spark, folder)).select(
        "language", "file", "task", *[f"delta_{d}" for d in DIMS]
    )


_TESTED_CLEAN = _TESTED.replace(DELTAS, _CLEAN)


@query(
    "sensitivity_tests",
    "select dimension, n_pairs, coalesce(m, 0) as n_nonzero, least(w_plus, w_minus) as statistic, round(z, 9) as z, round(p, 6) as p_value, round(holm_p, 6) as holm_p,"
    f" round(effect, 9) as effect from {_TESTED_CLEAN} t left join (select dimension as d2, holm_p from {_HOLM.replace(DELTAS, _CLEAN)}) h on h.d2 = t.dimension",
)
def sensitivity_tests(spark, folder):
    result = paired.sensitivity(deltas(spark, folder), scores(spark, folder))
    return rounded(
        rounded(result, "z", "effect"), "p_value", "holm_p", digits=6
    ).select("dimension", "n_pairs", "n_nonzero", "statistic", "z", "p_value", "holm_p", "effect")


_TAGS = f"(select unnest(list_filter(list_transform(string_split(failure_modes, ';'), lambda t: trim(t)), lambda t: t not in ('', 'none'))) as tag from {duck.SCORES})"


@query(
    "failure_tag_counts",
    f"select coalesce(k.tag, s.tag) as tag, coalesce(n, 0) as n from (select unnest([{', '.join(duck.dq(t) for t in fv.FAILURE_TAGS)}]) as tag) k"
    f" full join (select tag, count(*) as n from {_TAGS} group by all) s on s.tag = k.tag",
)
def failure_tag_counts(spark, folder):
    return paired.tag_counts(scores(spark, folder))


_WANTED = (
    f"(select * from (select distinct language, file from {duck.SCORES}) cross join (select unnest([{', '.join(duck.dq(t) for t in fv.TASKS)}]) as task)"
    " cross join (select unnest(['original', 'sanitized']) as condition)"
    f" where task <> '{fv.CONFIG_ONLY_TASK}' or language in {duck.words(fv.CONFIG_LANGUAGES)})"
)


@query(
    "coverage_matrix",
    f"select * from (select coalesce(w.language, s.language) as language, coalesce(w.file, s.file) as file, coalesce(w.task, s.task) as task, coalesce(w.condition, s.condition) as condition,"
    f" case when s.n is null then 'missing' when w.file is null then 'not_applicable' when s.n > 1 then 'duplicate' end as problem from {_WANTED} w full join"
    f" (select {KEYS}, condition, count(*) as n from {duck.SCORES} group by all) s on s.language = w.language and s.file = w.file and s.task = w.task and s.condition = w.condition)"
    " where problem is not null",
)
def coverage_matrix(spark, folder):
    return paired.coverage_matrix(scores(spark, folder))


# some scores out of range, some rows scored against the rules
_BROKEN = """select language, file, task, condition, case when length(file) % 3 = 0 then correctness + 3 else correctness end as correctness, completeness, consistency, usefulness,
 case when length(response_file) % 4 = 0 then 4 else misunderstood_value end as misunderstood_value, case when length(response_file) % 5 = 0 then null else relationships_preserved end as relationships_preserved from {scores}"""


@query(
    "invalid_scores",
    f"select {KEYS}, condition, rule from (select {KEYS}, condition, unnest([case when correctness not between 1 and 5 then 'correctness' end,"
    " case when (condition = 'original') <> (misunderstood_value is null) then 'misunderstood_value' end,"
    f" case when (task <> '{fv.CONFIG_ONLY_TASK}') <> (relationships_preserved is null) then 'relationships_preserved' end]) as rule from ({_BROKEN.format(scores=duck.SCORES)})) where rule is not null",
)
def invalid_scores(spark, folder):
    return paired.invalid_scores(spark.sql(_BROKEN.format(scores="{scores}"), scores=scores(spark, folder)))


_WORDS = ["the", "token", "que", "placeholder", "der"]


@query(
    "keyword_sweep",
    " union all ".join(
        f"select '{w}' as word, count(*) filter (contains(lower(text), '{w}')) as n_texts, cast(sum((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}) as bigint) as n_hits"
        " from (select text from conversations union all select text from documents)" for w in _WORDS
    ),
)
def keyword_sweep(spark, folder):
    texts = table(spark, folder, "conversations").select("text").unionByName(table(spark, folder, "documents").select("text"))
    return paired.keyword_sweep(texts, _WORDS)


@query(
    "inference_table",
    "select t.dimension, t.n_pairs, coalesce(m, 0) as n_nonzero, w_plus, w_minus, least(w_plus, w_minus) as statistic, round(z, 9) as z, round(p, 6) as p_value,"
    " round(effect, 9) as effect, round(holm_p, 6) as holm_p, median, mean, ci_lower, ci_upper, holm_p < 0.05 as significant"
    f" from {_TESTED} t left join (select dimension as d2, holm_p from {_HOLM}) h on h.d2 = t.dimension join (select dimension as d3, ci_lower, ci_upper from {_BOOT}) b on b.d3 = t.dimension"
    f" join (select dimension as d4, median(delta) as median, round(avg(delta), 9) as mean from {LONG} group by all) s on s.d4 = t.dimension",
)
def inference_table(spark, folder):
    """The confirmatory table as a whole, with the bootstrap interval."""
    table = paired.inference(deltas(spark, folder))
    return rounded(rounded(table, "z", "effect", "mean"), "p_value", "holm_p", digits=6)

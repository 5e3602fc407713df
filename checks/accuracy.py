"""Checks of the accuracy and quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright import fixed_values as fv
from maskwright.operators import accuracy as acc
from maskwright.operators.hits import findings
from maskwright.operators.blocks import concat_for_kind
from maskwright.operators.paths import classify
from maskwright.plans.scan import scan
from maskwright.session import materialize
from maskwright.sources.corpus import explode_lines

from . import carriers, duck
from .detection import GO_CHAINS, GO_FILES, JAVA_FILES, MASKED, PY_FILES, RULES, TOKENS
from .registry import as_files, block_files, carrier, query, table

# ---- labelled lines --------------------------------------------------------


def cases(spark, folder):
    return carrier(spark, folder, carriers.CASES)


def case_texts(spark, folder):
    return as_files(carrier(spark, folder, carriers.CASE_FILES))


def case_files(spark, folder, ctx=MASKED):
    """The labelled files scanned, once for all that a check needs of them."""
    return materialize(scan(case_texts(spark, folder), ctx).select("path", "text", "result"), "cases")


def found_in(scanned):
    return findings(scanned, "path").withColumnRenamed("path", "file")


def sanitized(scanned):
    return scanned.selectExpr("path as file", "result.out as text")


_L = f"(select path, 2 as line_no, line from {duck.CASE_FILES})"
_ENV = f"(select * from {_L} where path like '%.env')"
_TXT = f"(select * from {_L} where path like '%.txt')"
FOUND = (
    f"(select path as file, line_no as line, rule, value from ({duck.shape_findings(_ENV)})"
    f" union all select path, line_no, rule, value from ({duck.shape_findings(_TXT, fv.FALLBACK_RULES, 'fallback:')}))"
)
OUT = (
    f"(select path as file, line, out from ({duck.shape_out(_ENV)}) union all select path, line, out from ({duck.shape_out(_TXT, fv.FALLBACK_RULES)}))"
)
OUTCOMES = (
    "(select c.*, case when expected_detection then case when f.file is not null then 'TP' else 'FN' end when f.file is not null then 'FP' else 'TN' end as outcome"
    f" from {duck.CASES} c left join (select distinct file, line from {FOUND}) f on f.file = c.file and f.line = c.line)"
)


def outcomes(spark, folder, files=None):
    files = case_files(spark, folder) if files is None else files
    return acc.label_outcomes(cases(spark, folder), found_in(files))


@query("label_outcomes", f"select id, file, line, outcome from {OUTCOMES}")
def label_outcomes(spark, folder):
    return outcomes(spark, folder).select("id", "file", "line", "outcome")


_METRICS = (
    "round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall,"
    " round(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) end, 9) as f1,"
    " round(fp / nullif(fp + tn, 0), 9) as false_positive_rate"
)
_COUNTS = (
    "count(*) filter (outcome = 'TP') as tp, count(*) filter (outcome = 'FP') as fp, count(*) filter (outcome = 'FN') as fn, count(*) filter (outcome = 'TN') as tn"
)


def rounded(df):
    names = ("precision", "recall", "f1", "false_positive_rate")
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("precision_recall", f"select *, {_METRICS} from (select {_COUNTS} from {OUTCOMES})")
def precision_recall(spark, folder):
    return rounded(acc.prf(outcomes(spark, folder)))


_GROUPS = " union all ".join(
    [f"select '{c}' as dimension, coalesce(nullif({c}, ''), '(unspecified)') as value, outcome from {OUTCOMES}" for c in ("language", "file_type", "category")]
    + [f"select 'overall' as dimension, '(all)' as value, outcome from {OUTCOMES}"]
)


@query(
    "precision_recall_by_group",
    f"select *, {_METRICS} from (select dimension, value, {_COUNTS}, count(*) as case_count from ({_GROUPS}) group by dimension, value)",
)
def precision_recall_by_group(spark, folder):
    return rounded(acc.prf_by(outcomes(spark, folder)))


@query(
    "unexpected_findings",
    f"select file, line, rule from {FOUND} f where not exists (select 1 from {duck.CASES} c where c.file = f.file and c.line = f.line)",
)
def unexpected_findings(spark, folder):
    return acc.unexpected(found_in(case_files(spark, folder)), cases(spark, folder)).select("file", "line", "rule")


_SPAN = (
    "(select o.id, o.file, o.line, o.original_value, o.expected_output_line, s.out, case when o.expected_output_line is not null then s.out = o.expected_output_line"
    " else list_bool_and(list_transform(v.vs, lambda x: not contains(s.out, x))) end as span_ok"
    f" from {OUTCOMES} o join {OUT} s on s.file = o.file join (select file, line, list(value) as vs from {FOUND} group by all) v on v.file = o.file and v.line = o.line"
    " where o.outcome = 'TP')"
)


@query("span_check", f"select id, file, line, span_ok from {_SPAN}")
def span_check(spark, folder):
    files = case_files(spark, folder)
    found = found_in(files)
    return acc.span_check(outcomes(spark, folder, files), found, sanitized(files)).select("id", "file", "line", "span_ok")


# odd cases get their text repeated on another line, so that some values leak
_LEAKY = "case when length(text) % 5 = 0 then concat(text, old_line) else text end"


@query(
    "leaks_mask_mode",
    "select id, file, line, span_ok, length(original_value) >= 8 and (case when expected_output_line is not null and span_ok then contains(rest, original_value)"
    " else contains(out, original_value) or contains(rest, original_value) end) as leaked from (select *, case when length(full_out) % 5 = 0 then old else '' end as rest from"
    f" (select s.*, 'top of file' || chr(10) || s.out || chr(10) as full_out, c.line as old from {_SPAN} s join {duck.CASE_FILES} c on c.path = s.file))",
)
def leaks_mask_mode(spark, folder):
    files = case_files(spark, folder)
    old = carrier(spark, folder, carriers.CASE_FILES).selectExpr("path as file", "line as old_line")
    leaky = sanitized(files).join(old, "file").withColumn("text", F.expr(_LEAKY)).drop("old_line")
    return acc.leaks_mask(outcomes(spark, folder, files), found_in(files), leaky).select("id", "file", "line", "span_ok", "leaked")


@query(
    "leaks_token_mode",
    # a value around another token does not occur in the input, so its count cannot drop
    f"select f.file, f.line, f.rule, contains(extra, f.value) or contains(f.value, '{fv.MASK}') as leaked from {FOUND} f join (select distinct file, line from {OUTCOMES} where outcome = 'TP') o"
    " on o.file = f.file and o.line = f.line join (select path as file, case when strlen(path) % 5 = 0 then line else '' end as extra"
    f" from {duck.CASE_FILES}) x on x.file = f.file",
)
def leaks_token_mode(spark, folder):
    files = case_files(spark, folder, TOKENS)
    found = found_in(files)
    original = files.selectExpr("path as file", "text")
    old = carrier(spark, folder, carriers.CASE_FILES).selectExpr("path as file", "line as old_line")
    leaky = sanitized(files).join(old, "file").withColumn(
        "text", F.expr("if(octet_length(file) % 5 = 0, concat(text, old_line), text)")
    )
    return acc.leaks_token(outcomes(spark, folder, files), found, original, leaky).select("file", "line", "rule", "leaked")


_GROUPED = (
    "(select o.value_group, o.file, case when f.rule like '%generic_url' then 'T' || cast(strlen(o.file) % 2 as varchar) else 'U' end as after"
    f" from {OUTCOMES} o join {FOUND} f on f.file = o.file and f.line = o.line where o.outcome = 'TP' and o.value_group is not null)"
)


def faked(found):
    """Replacements that sometimes differ inside a group."""
    return found.withColumn("after", F.expr("if(rule like '%generic_url', concat('T', cast(octet_length(file) % 2 as string)), 'U')"))


@query(
    "token_consistency",
    f"select value_group, count(distinct after) as n_tokens, count(distinct after) <= 1 as consistent from {_GROUPED} group by all",
)
def token_consistency(spark, folder):
    files = case_files(spark, folder)
    return acc.consistency(outcomes(spark, folder, files), faked(found_in(files)))


_OWNED = (
    "(select o.expected_placeholder_category as category, o.original_value, case when length(f.value) % 4 = 0 then '' else '<T_' || cast(length(f.value) % 3 as varchar) || '>' end as token"
    f" from {OUTCOMES} o join {FOUND} f on f.file = o.file and f.line = o.line where o.outcome = 'TP' and o.expected_placeholder_category is not null)"
)


@query(
    "token_distinctness",
    f"select category, token, count(distinct original_value) as n_values from {_OWNED} where token <> '' group by all having count(distinct original_value) > 1",
)
def token_distinctness(spark, folder):
    files = case_files(spark, folder)
    found = found_in(files).withColumn(
        "after", F.expr("if(length(value) % 4 = 0, '', concat('<T_', cast(length(value) % 3 as string), '>'))")
    )
    return acc.distinctness(outcomes(spark, folder, files), found)


# ---- multi-line values -----------------------------------------------------

_CHAINED = " union all ".join(
    f"select path, len(parts) as n from ({duck.judged(f, p)})" for f, p in ((PY_FILES, [duck.PY_CHAIN]), (JAVA_FILES, [duck.PLUS_CHAIN]), (GO_FILES, GO_CHAINS))
)
# labels of the two lines of every chain, whether or not it is found
CHAIN_CASES = """
select path as file, cast(i + case when path like '%.py' then 1 else 0 end as int) as line, path as value_group, 'multiline_secret' as category, true as expected_detection
from ({BLOCKS}) b, (select 1 as i union all select 2) two where path like '%.py' or path like '%.java' or path like '%.go'
""".replace("{BLOCKS}", carriers.BLOCK_FILES)


@query(
    "multiline_token_consistency",
    f"select path as value_group, case when strlen(path) % 2 = 0 then n else 1 end as n_tokens, strlen(path) % 2 = 1 or n = 1 as consistent from ({_CHAINED})",
)
def multiline_token_consistency(spark, folder):
    """Each labelled chain is a value group: its first fragment has the token, others
    none, unless (in half of the files) something went wrong and they have one as well."""
    files = block_files(spark, folder).withColumn("kind", F.expr(classify("path")))
    scanned = files.withColumn("result", F.expr(concat_for_kind("text", "kind", TOKENS)))
    found = findings(scanned, "path").withColumnRenamed("path", "file")
    found = found.withColumn("after", F.expr("if(octet_length(file) % 2 = 0 and after = '', '<GENERIC_SECRET_0>', after)"))
    return acc.consistency_multiline(acc.label_outcomes(carrier(spark, folder, CHAIN_CASES), found), found)


# ---- comparing runs --------------------------------------------------------


@query("run_diff", "select file, rule, 'second' as only_in, 1 as surplus from " + FOUND + " where rule like '%github_token'")
def run_diff(spark, folder):
    """Two runs, the first without one rule: the difference is that rule."""
    fewer = MASKED.narrow(*[r.name for r in RULES.values if r.name != "github_token"])
    first, second = (found_in(case_files(spark, folder, c)).select("file", "rule") for c in (fewer, MASKED))
    return acc.run_diff(first, second)


@query("mode_parity", f"select file, line, rule, cast(1 as bigint) as surplus, 'first' as only_in from {FOUND} where false")
def mode_parity(spark, folder):
    """Mask and token mode find the same places."""
    masked, tokens = (found_in(case_files(spark, folder, c)) for c in (MASKED, TOKENS))
    return acc.mode_parity(masked, tokens)


# ---- format and fingerprints -----------------------------------------------

FORMAT_FILES = """select concat('x/', cast(c_custkey as string), case c_custkey % 5 when 0 then '.json' when 1 then '.xml' when 2 then '.java' when 3 then '.go' else '.env' end) as path,
 case c_custkey % 5 when 0 then case c_custkey % 7 when 0 then '{{"a": 1}} x' when 1 then '{{"a": 1, "a": [2]}}' when 2 then '[NaN, -Infinity]' else concat('{{"k": ["', c_name, '"', case when c_custkey % 3 = 0 then '' else ']' end, '}}') end
 when 1 then case c_custkey % 7 when 0 then '<a/><b/>' when 1 then '<a/> x' else concat('<a b="1"><c>', case c_custkey % 3 when 0 then '<PASSWORD_1>' when 1 then '&lt;PASSWORD_1&gt;' else c_name end, '</c></a>') end
 when 2 then concat('class A {{ String s = "', case c_custkey % 3 when 0 then 'a\\"b]' when 1 then '***REDACTED***' else '{{' end, '"; }}', case when c_custkey % 7 = 0 then '}}' else '' end)
 when 3 then concat('func f() {{ x := "', c_name, case when c_custkey % 4 = 0 then '' else '"' end, ' }}') else 'A=b' end as text, c_custkey as id
 from {customer}"""
FORMAT_STATUS = """case id % 5 when 0 then case when id % 7 = 0 then 'invalid' when id % 7 <= 2 then 'valid' when id % 3 = 0 then 'invalid' else 'valid' end
 when 1 then case when id % 7 <= 1 then 'invalid' when id % 3 = 0 then 'invalid' else 'valid' end
 when 2 then case when id % 7 = 0 then 'heuristic_invalid' else 'heuristic_valid' end when 3 then case when id % 4 = 0 then 'heuristic_invalid' else 'heuristic_valid' end else 'not_applicable' end"""
_FORMAT = f"(select path, {FORMAT_STATUS} as status from ({carriers.for_duckdb(FORMAT_FILES)}))"


def format_files(spark, folder):
    escaped = FORMAT_FILES.replace("\\\\", "\\\\\\\\").replace('\\"', '\\\\"')
    return carrier(spark, folder, escaped).drop("id")


@query("format_check", f"select path, status from {_FORMAT}")
def format_check(spark, folder):
    return acc.check_format(format_files(spark, folder))


@query("format_summary", f"select status, count(*) as n_files from {_FORMAT} group by all")
def format_summary(spark, folder):
    return acc.format_summary(acc.check_format(format_files(spark, folder)))


@query(
    "fingerprint_audit",
    "select concat('doc_', cast(doc_id as string)) as path, case when doc_id % 17 = 0 then 'new' when doc_id % 10 = 0 then 'changed' when doc_id % 7 = 0 then 'same_but_line_ends' else 'same' end as status"
    " from documents union all select concat('gone_', cast(page_id as string)), 'missing' from pages",
)
def fingerprint_audit(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("doc_id", "concat('doc_', cast(doc_id as string)) as path", "text")
    files = docs.selectExpr("path", "sha2(text, 256) as hash", "sha2(replace(text, '\\r', ''), 256) as text_hash")
    kept = docs.where("doc_id % 17 <> 0").selectExpr(
        "path", "case when doc_id % 10 = 0 then concat(text, 'x') when doc_id % 7 = 0 then concat('\\r', text) else text end as old"
    )
    manifest = kept.selectExpr("path", "sha2(old, 256) as hash", "sha2(replace(old, '\\r', ''), 256) as text_hash").unionByName(
        table(spark, folder, "pages").selectExpr("concat('gone_', cast(page_id as string)) as path", "md5(html) as hash", "md5(html) as text_hash")
    )
    return acc.fingerprint_audit(files, manifest)


@query(
    "dangling_labels",
    "select c.id, c.file, c.line, case when f.path is null then 'file_absent' else 'line_out_of_range' end as problem"
    f" from {duck.CASES} c left join {duck.CASE_FILES} f on f.path = c.file where f.path is null or c.line > len(string_split(rtrim(f.text, chr(10)), chr(10)))",
)
def dangling_labels(spark, folder):
    lengths = explode_lines(case_texts(spark, folder)).groupBy(F.col("path").alias("file")).agg(F.max("line_no").alias("n_lines"))
    return acc.dangling_labels(cases(spark, folder), lengths)


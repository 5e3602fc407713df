"""Checks of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright import fixed_values as fv
from maskwright.operators import shapes
from maskwright.operators.accuracy import label_outcomes, prf_by
from maskwright.operators.history import safe_findings
from maskwright.operators.config import detect_config
from maskwright.operators.hits import findings
from maskwright.plans.scan import sanitize_masked
from maskwright.rules import value_rule_table
from maskwright.session import new_folder
from maskwright.sources import corpus, evaluation, sinks

from . import carriers, duck
from .detection import MASKED, RULES, TREE_OUT
from .registry import (
    carrier, cfg_lines, code_lines, doc_files, line_files, page_files, query, table, text_lines, tree_files,
)

# ---- corpus ----------------------------------------------------------------


@query(
    "corpus_from_table",
    "select concat(source, '/', lang, '/doc_', cast(doc_id as string), '.txt') as path, strlen(text) as length, md5(text) as text_hash from documents"
    " union all select concat('page_', cast(page_id as string), '.html'), strlen(html), md5(html) from pages"
    " union all select concat('conv_', cast(conv_id as string), '_', cast(turn as string)), strlen(text), md5(text) from conversations",
)
def corpus_from_table(spark, folder):
    turns = corpus.from_table(
        table(spark, folder, "conversations"), "concat('conv_', cast(conv_id as string), '_', cast(turn as string))", "text"
    )
    files = doc_files(spark, folder).unionByName(page_files(spark, folder)).unionByName(turns)
    return files.selectExpr("path", "length", "md5(text) as text_hash")


@query(
    "tree_read",
    "select concat('lang=', lang, '/source=', source) as dir, cast(sum(1 + length(text) - length(replace(text, chr(10), ''))) as bigint) as n_lines,"
    " cast(sum(length(replace(text, chr(10), ''))) as bigint) as n_chars, cast(sum(list_sum(list_transform(string_split(text, chr(10)), lambda x: cast('0x' || substr(md5(x), 1, 8) as bigint)))) as bigint) as hashes from documents group by all",
)
def tree_read(spark, folder):
    """Write the documents as a tree of text files and read the tree back."""
    root = new_folder(spark, "tree")
    table(spark, folder, "documents").select("text", "lang", "source").write.partitionBy("lang", "source").text(root)
    written = corpus.read_tree(spark, root).where("endswith(path, '.txt')")  # not the writer's marks and checksums
    files = corpus.decode_text(written)
    lines = corpus.explode_lines(files)
    return (
        lines.selectExpr("regexp_replace(path, '/[^/]*$', '') as dir", "line").groupBy("dir")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"),
             F.sum(F.expr("cast(conv(substr(md5(line), 1, 8), 16, 10) as bigint)")).alias("hashes"))
    )


@query("decode_invalid_bytes", "select doc_id, md5(concat(text, chr(10), chr(65533), 'end')) as text_hash from documents")
def decode_invalid_bytes(spark, folder):
    """Broken bytes drop out, a real U+FFFD stays, line ends become newlines."""
    files = table(spark, folder, "documents").selectExpr(
        "doc_id", "concat(encode(text, 'UTF-8'), X'FFC00D0AE282EFBFBD', encode('end', 'UTF-8'), X'80') as content"
    )
    return corpus.decode_text(files).selectExpr("doc_id", "md5(text) as text_hash")


LINES = (
    "select path, line_no, md5(line) as line_hash, case when line_no < n then chr(10) else '' end as eol from"
    " (select path, unnest(ls) as line, cast(generate_subscripts(ls, 1) as int) as line_no, len(ls) as n from"
    "  (select concat(source, '/', lang, '/doc_', cast(doc_id as string), '.txt') as path, string_split(text, chr(10)) as ls from documents))"
    " where not (line_no = n and line = '')"
)


@query("explode_lines", LINES)
def explode_lines(spark, folder):
    return corpus.explode_lines(doc_files(spark, folder)).selectExpr("path", "line_no", "md5(line) as line_hash", "eol")


@query(
    "rebuild_text",
    "select path, chunk, md5(string_agg(line || eol, '' order by line_no)) as text_hash from (select path, line_no, line, eol, cast((line_no - 1) // 8 as int) as chunk from ("
    + LINES.replace("md5(line) as line_hash", "line") + ")) group by path, chunk",
)
def rebuild_text(spark, folder):
    lines = corpus.explode_lines(doc_files(spark, folder))
    return corpus.rebuild(lines, 8).selectExpr("path", "chunk", "md5(text) as text_hash")


@query(
    "lines_per_rule",
    " union all ".join(
        f"select cast({i} as int) as ord, '{n}' as rule, '{k}' as category, count(*) as n_lines from {duck.TEXT_LINES} where regexp_matches(line, {duck.dq(duck.VALUE[n])})"
        for i, (n, _, k) in enumerate(fv.VALUE_RULES)
    ),
)
def lines_per_rule(spark, folder):
    """The rule table joined to what the rules match; rules without a match count 0."""
    names = "filter(array(" + ", ".join(f"if({shapes.matches('line', r)}, '{r.name}', null)" for r in RULES.values) + "), x -> x is not null)"
    hits = (
        text_lines(spark, folder).where(shapes.may_match("line", RULES)).select(F.explode(F.expr(names)).alias("rule"))
        .groupBy("rule").agg(F.count(F.lit(1)).alias("n_lines"))
    )
    return value_rule_table(spark, RULES).join(hits, "rule", "left").select(
        "ord", "rule", "category", F.coalesce("n_lines", F.lit(0)).alias("n_lines")
    )


# ---- sinks -----------------------------------------------------------------


@query(
    "sanitized_sink",
    f"select coalesce({duck.kind('path')}, 'other') as kind, path, md5(text) as text_hash from ({TREE_OUT})",
)
def sanitized_sink(spark, folder):
    out = new_folder(spark, "sanitized")
    sinks.write_sanitized(sanitize_masked(tree_files(spark, folder), MASKED), out, folder)
    return spark.read.parquet(out).selectExpr("kind", "path", "md5(text) as text_hash")


def cfg_found(spark, folder):
    found = findings(detect_config(cfg_lines(spark, folder), MASKED), "path", "line_no").drop("line")
    return found.withColumnsRenamed({"path": "file", "line_no": "line"})


@query(
    "findings_sink",
    f"select 7 as project_id, 70 as scan_id, key, rule, false as changed, count(*) as n from ({duck.config_all(duck.CFG)}) group by all",
)
def findings_sink(spark, folder):
    store = new_folder(spark, "findings")
    sinks.record_scan(cfg_found(spark, folder), store, 7, 70, "2024-01-01 00:00:00")
    stored = spark.read.parquet(store)
    return stored.selectExpr("cast(project_id as int) as project_id", "cast(scan_id as int) as scan_id", "key", "rule", "changed").groupBy(
        "project_id", "scan_id", "key", "rule", "changed"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("safe_findings", f"select path as file, line_no as line, key, rule, false as changed from ({duck.config_all(duck.CFG)})")
def safe(spark, folder):
    return safe_findings(cfg_found(spark, folder))


# ---- evaluation inputs -----------------------------------------------------

CASE_TEXT = """select case p_partkey % 10 when 0 then '# comment' when 1 then '   ' when 2 then concat('{{"id": "m', cast(p_partkey as string), '", "file": "a"}}')
 when 3 then concat('{{"id": "d', cast(p_partkey % 50 as string), '", "file": "', p_brand, '", "language": "go", "file_type": ".go", "category": "x", "expected_detection": true}}')
 when 4 then concat('{{"id": "b', cast(p_partkey as string), '", broken') else concat('{{"id": "c', cast(p_partkey as string), '", "file": "', p_brand, '", "line": ', cast(p_size as string),
 ', "language": "py", "file_type": ".py", "category": "y", "expected_detection": ', case p_partkey % 2 when 0 then 'true, "expected_sanitization": false' else 'false' end, '}}') end as value
from {part}"""


@query(
    "cases_read",
    "select concat('c', cast(p_partkey as string)) as id, p_brand as file, p_size as line, p_partkey % 2 = 0 as expected_detection, false as expected_sanitization, '' as notes"
    " from part where p_partkey % 10 >= 5 union all select concat('d', cast(k as string)), b, null, true, true, '' from (select p_partkey % 50 as k, min(p_brand) as b, count(*) as n from part where p_partkey % 10 = 3 group by 1) where n = 1",
)
def cases_read(spark, folder):
    cases, _ = evaluation.parse_cases(carrier(spark, folder, CASE_TEXT))
    return cases.select("id", "file", "line", "expected_detection", "expected_sanitization", "notes")


@query(
    "cases_rejected",
    "select concat('m', cast(p_partkey as string)) as id, 'missing_language_file_type_category_expected_detection' as reason from part where p_partkey % 10 = 2"
    " union all select concat('d', cast(p_partkey % 50 as string)), 'duplicate_id' from part where p_partkey % 10 = 3 and p_partkey % 50 in (select p_partkey % 50 from part where p_partkey % 10 = 3 group by 1 having count(*) > 1)"
    " union all select null, 'invalid_json' from part where p_partkey % 10 = 4",
)
def cases_rejected(spark, folder):
    _, rejects = evaluation.parse_cases(carrier(spark, folder, CASE_TEXT))
    return rejects


TAG_LIST = "array_to_string(list_filter(list_transform(string_split(failure_modes, ';'), lambda t: trim(t)), lambda t: t not in ('', 'none')), '|')"


@query(
    "scores_read",
    f"select file, task, condition, correctness, misunderstood_value, relationships_preserved, {TAG_LIST} as tags from {duck.SCORES}",
)
def scores_read(spark, folder):
    """Scores written as CSV with N/A and read back under the declared schema."""
    out = new_folder(spark, "scores")
    carrier(spark, folder, carriers.SCORES).write.option("header", "true").option("nullValue", "N/A").csv(out)
    return evaluation.read_scores(spark, out).selectExpr(
        "file", "task", "condition", "correctness", "misunderstood_value", "relationships_preserved", "array_join(tags, '|') as tags"
    )


RESULTS = (
    "with o as (select cast(line_no % 3 as string) as category, case when line_no % 2 = 0 then case when line_no % 3 <> 1 then 'TP' else 'FN' end"
    f" when line_no % 3 <> 1 then 'FP' else 'TN' end as outcome from {duck.CODE}),"
    " d as (select 'overall' as dimension, '(all)' as value, outcome from o union all select 'language', 'l', outcome from o"
    " union all select 'file_type', 't', outcome from o union all select 'category', category, outcome from o)"
    " select dimension, value, count(*) filter (outcome = 'TP') as tp, count(*) filter (outcome = 'FP') as fp, count(*) filter (outcome = 'FN') as fn,"
    " count(*) filter (outcome = 'TN') as tn, count(*) as case_count from d group by all"
)


@query("results_sink", RESULTS)
def results_sink(spark, folder):
    """Accuracy table of labelled code lines, as JSON lines."""
    lines = code_lines(spark, folder).selectExpr(
        "path as file", "line_no as line", "'l' as language", "'t' as file_type", "cast(line_no % 3 as string) as category", "line_no % 2 = 0 as expected_detection"
    )
    found = lines.where("line % 3 <> 1").select("file", "line")
    out = new_folder(spark, "results")
    sinks.write_results(prf_by(label_outcomes(lines, found)), out)
    return spark.read.schema("dimension string, value string, tp long, fp long, fn long, tn long, case_count long").json(out)

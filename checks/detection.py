"""Checks of classification, detection and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright import fixed_values as fv
from maskwright.functions import text as tx
from maskwright.operators import blocks, code, config, keys, paths, shapes
from maskwright.operators.hits import findings, mask_context, token_context
from maskwright.plans.scan import rows_where, scan, scan_findings
from maskwright.rules import default_rules

from . import carriers, duck
from .registry import (
    as_files, block_files, carrier, cfg_lines, code_lines, dealt, doc_lines, line_files, plain_marks, query, shape_lines,
    table, text_lines, tree_files,
)

RULES = default_rules()
MASKED = mask_context(RULES)
TOKENS = token_context(RULES)
FOUND = ("path", "line_no", "key", "rule", "category", "value")



def changed(scanned, *keep, test="size(result.hits) > 0", **more):
    """Rows whose result passes a test, with their new text; detectors run once a row.  The
    text, which no such row lacks, comes first, since paths may be null."""
    return rows_where(scanned, test, out="result.out", **{c: c for c in keep}, **more).select(*keep, *more, "out")


# ---- file names ------------------------------------------------------------

_VARIED = """select concat(case doc_id % 9 when 0 then 'node_modules/' when 1 then 'src/build/' when 2 then 'a/b/' when 3 then 'Target/' when 4 then '.git/' else 'x/' end, source, '/', lang, '/',
 case doc_id % 13 when 0 then '.env' when 1 then '.env.local' when 2 then 'build' when 3 then 'A.JAVA' when 4 then 'b.tar.gz' when 5 then 'c.Tsx' when 6 then 'noext' when 7 then 'd.yml' when 8 then 'e.config' when 9 then 'f.png' when 10 then '.bashrc' when 11 then 'g.dart' else 'h.txt' end, cast(doc_id as string),
 case doc_id % 13 when 3 then '.java' when 4 then '.gz' when 7 then '.yml' when 8 then '.CONFIG' when 9 then '.png' when 11 then '.dart' when 12 then '.txt' else '' end) as path,
 text, doc_id, strlen_ as length from (select *, {length} as strlen_ from {source}) v0"""


def varied(spark, folder):
    return spark.sql(_VARIED.format(length="cast(octet_length(text) as bigint)", source=f"parquet.`{folder}/documents.parquet`"))


VARIED = "(" + _VARIED.format(length="cast(strlen(text) as bigint)", source="documents") + ")"
SKIPPED = "(len(list_intersect(list_slice(string_split(path, '/'), 1, -2), [" + ", ".join(duck.dq(d) for d in fv.SKIP_DIRS) + "])) > 0)"


@query("classify_files", f"select path, {duck.kind('path')} as kind from {VARIED}")
def classify_files(spark, folder):
    return varied(spark, folder).selectExpr("path", f"{paths.classify('path')} as kind")


@query("prune_skip_dirs", f"select path from {VARIED} where not {SKIPPED}")
def prune_skip_dirs(spark, folder):
    return paths.prune_skip_dirs(varied(spark, folder).select("path"))


@query("file_listing", f"select path from {VARIED} where not {SKIPPED} order by path")
def file_listing(spark, folder):
    return paths.list_files(varied(spark, folder))


EXCLUDED = "(select distinct case p_partkey % 3 when 0 then path else regexp_extract(path, '^[^/]*/[^/]*', 0) end as path from (select *, line_no as p_partkey from {shape}) e0 where p_partkey % 7 = 0 and path like 'misc/Brand#1%')"


@query(
    "exclude_paths",
    f"select distinct path from {duck.SHAPE} s where not exists (select 1 from {EXCLUDED.format(shape=duck.SHAPE)} e"
    " where s.path = e.path or starts_with(s.path, e.path || '/'))",
)
def exclude_paths(spark, folder):
    lines = shape_lines(spark, folder)
    excluded = spark.sql(EXCLUDED.format(shape="{lines}")[1:-1], lines=lines)
    return paths.exclude(lines.select("path").distinct(), excluded)


CHECKED = "select distinct path, (path like 'misc/Brand#2%' or path like '%f1_.txt') as checked from {shape}"
DIRS = """(select path, checked, unnest(['', 'misc', regexp_extract(path, '^[^/]*/[^/]*', 0)]) as dir from ({checked}))"""
DUCK_DIRS = DIRS.format(checked=CHECKED.format(shape=duck.SHAPE))
STATES = (
    "select dir, count(*) as n_files, cast(sum(checked::int) as bigint) as n_checked, case when sum(checked::int) = 0 then 'unchecked'"
    f" when sum(checked::int) = count(*) then 'checked' else 'indeterminate' end as state from {DUCK_DIRS} group by dir"
)


def checked_paths(spark, folder):
    return spark.sql(CHECKED.format(shape="{lines}"), lines=shape_lines(spark, folder))


@query("folder_states", STATES)
def folder_states(spark, folder):
    return paths.folder_state(checked_paths(spark, folder))


@query(
    "minimal_exclusions",
    f"with st as ({STATES}), n as (select dir as path from st where state = 'unchecked' union all"
    f" select path from ({CHECKED.format(shape=duck.SHAPE)}) where not checked)"
    " select path from n where path = '' or regexp_replace(path, '/?[^/]*$', '') not in (select dir from st where state = 'unchecked')",
)
def minimal_exclusions(spark, folder):
    return paths.collapse_exclusions(checked_paths(spark, folder))


DOC_HASH = "select concat('doc_', cast(doc_id as string)) as path, md5(text) as hash, doc_id from {docs}"


@query(
    "only_changed_files",
    "select path, true as partial from (" + DOC_HASH.format(docs="documents") + ") where doc_id % 10 = 0 or doc_id % 17 = 0",
)
def only_changed_files(spark, folder):
    files = spark.sql(DOC_HASH.format(docs="{docs}"), docs=table(spark, folder, "documents"))
    manifest = files.where("doc_id % 17 <> 0").selectExpr("path", "if(doc_id % 10 = 0, 'stale', hash) as hash")
    return paths.only_changed(files, manifest).select("path", "partial")


@query("oversize_files", f"select path, length * 100 > 2097152 as oversize from {VARIED}")
def oversize_files(spark, folder):
    return varied(spark, folder).selectExpr("path", f"{paths.is_oversize('length * 100')} as oversize")


BINARY = "(regexp_matches(lower(path), '[^/]\\.(" + "|".join(fv.BINARY_EXTENSIONS) + ")$') or (doc_id % 5 = 0 and length < 8192))"


def with_bytes(df):
    return df.withColumn("content", F.expr("if(doc_id % 5 = 0, concat(encode(text, 'UTF-8'), X'00'), encode(text, 'UTF-8'))"))


@query("binary_files", f"select path, {BINARY} as is_binary from {VARIED}")
def binary_files(spark, folder):
    return with_bytes(varied(spark, folder)).selectExpr("path", f"{paths.is_binary('path', 'content', fv.BINARY_SNIFF_BYTES)} as is_binary")


@query(
    "coverage_labels",
    f"select path, kind, reason, case when reason is not null then 'unscanned' when kind is null then 'fallback' else 'scanned' end as status from"
    f" (select path, kind, case when kind is not null then null when length * 100 > 2097152 then 'oversize' when {BINARY} then 'binary' end as reason"
    f" from (select *, {duck.kind('path')} as kind from {VARIED}))",
)
def coverage_labels(spark, folder):
    return paths.coverage(with_bytes(varied(spark, folder)).withColumn("length", F.expr("length * 100")), paths.QUICK)


# ---- values ----------------------------------------------------------------

VALUES = f"(select path, line_no, value from ({duck.settings(duck.CFG)}) union all select path, line_no, line as value from {duck.TEXT_LINES})"


def cfg_values(spark, folder):
    """Setting values, and whole lines of text."""
    settings = config.extract_settings(cfg_lines(spark, folder)).select("path", "line_no", "value")
    return settings.unionByName(text_lines(spark, folder).withColumnRenamed("line", "value"))


@query("dummy_values", f"select path, line_no, {duck.is_dummy('value')} as is_dummy from {VALUES}")
def dummy_values(spark, folder):
    return cfg_values(spark, folder).selectExpr("path", "line_no", f"{tx.is_dummy('value', RULES.allowlist)} as is_dummy")


@query("value_entropy", f"select path, line_no, round({duck.entropy('value')}, 9) as bits from {VALUES}")
def value_entropy(spark, folder):
    return cfg_values(spark, folder).selectExpr("path", "line_no", f"round({tx.entropy('value')}, 9) as bits")


@query("high_entropy_values", f"select path, line_no, {duck.high_entropy('value')} as high from {VALUES}")
def high_entropy_values(spark, folder):
    return cfg_values(spark, folder).selectExpr("path", "line_no", f"{tx.high_entropy('value')} as high")


@query("identity_values", f"select path, line_no, {duck.identity('value')} as identity from ({duck.settings(duck.CFG)})")
def identity_values(spark, folder):
    return config.extract_settings(cfg_lines(spark, folder)).selectExpr("path", "line_no", f"{tx.identity_value('value')} as identity")


@query(
    "quoted_replacements",
    f"select path, line_no, {duck.wrap('value', "'new'", 'false')} as plain, {duck.wrap('value', "'new'", 'true')} as forced from ({duck.settings(duck.CFG)})",
)
def quoted_replacements(spark, folder):
    return config.extract_settings(cfg_lines(spark, folder)).selectExpr(
        "path", "line_no", f"{tx.wrap_quotes('value', tx.q('new'))} as plain", f"{tx.wrap_quotes('value', tx.q('new'), 'true')} as forced"
    )


# ---- settings and keys -----------------------------------------------------

CFG_AND_DOCS = f"(select path, line_no, line from {duck.CFG} union all select path, line_no, line from {duck.DOC_LINES})"


def cfg_and_docs(spark, folder):
    return cfg_lines(spark, folder).unionByName(doc_lines(spark, folder))


def _register_setting_shape(shape):
    @query(f"settings_{shape.name}", duck.settings_of(shape.name, CFG_AND_DOCS))
    def run(spark, folder):
        return config.settings_of_shape(cfg_and_docs(spark, folder), shape).select("path", "line_no", "key", "value")


for _shape in config.SETTING_SHAPES:
    _register_setting_shape(_shape)


@query("extract_settings", f"select path, line_no, shape, key, value from ({duck.settings(CFG_AND_DOCS)})")
def extract_settings(spark, folder):
    return config.extract_settings(cfg_and_docs(spark, folder)).select("path", "line_no", "shape", "key", "value")


KEY_LIST = ", ".join(f"case when {duck.strict_hit('key', p)} then {i} end" for i, (p, _) in enumerate(fv.KEY_RULES))


@query(
    "config_key_hits",
    f"select path, line_no, array_to_string(list_filter([{KEY_LIST}], lambda x: x is not null), ',') as hits from ({duck.settings(duck.CFG)})",
)
def config_key_hits(spark, folder):
    hits = keys.key_hits("key", RULES)
    return config.extract_settings(cfg_lines(spark, folder)).selectExpr(
        "path", "line_no", f"array_join(transform({hits}, h -> cast(h.ord as string)), ',') as hits"
    )


NAME_LIST = ", ".join(f"case when {duck.camel_hit('name', p)} then {i} end" for i, (p, _) in enumerate(fv.KEY_RULES))


@query(
    "identifier_hits",
    f"select id, name, array_to_string(list_filter([{NAME_LIST}], lambda x: x is not null), ',') as hits from {duck.IDENTS}",
)
def identifier_hits(spark, folder):
    hits = keys.ident_hits("name", RULES)
    return carrier(spark, folder, carriers.IDENTS).selectExpr(
        "id", "name", f"array_join(transform({hits}, h -> cast(h.ord as string)), ',') as hits"
    )


@query("most_specific_category", f"select id, {duck.key_category('name', duck.camel_hit)} as category from {duck.IDENTS}")
def most_specific_category(spark, folder):
    hits = keys.ident_hits("name", RULES)
    return carrier(spark, folder, carriers.IDENTS).selectExpr(
        "id", tx.let(hits, lambda h: keys.most_specific(f"{h}.category")) + " as category"
    )


SEGMENT = "(?i)^(.*?)(" + duck.KW + ")(.*)$"


@query(
    "identifier_segments",
    f"select id, name, {duck.segment_ok('a', 'b', 'c')} as ok from (select id, name, regexp_extract(name, '{SEGMENT}', 1) as a,"
    f" regexp_extract(name, '{SEGMENT}', 2) as b, regexp_extract(name, '{SEGMENT}', 3) as c from {duck.IDENTS}) where b <> ''",
)
def identifier_segments(spark, folder):
    cut = carrier(spark, folder, carriers.IDENTS).selectExpr(
        "id", "name", *[f"{tx.extract('name', SEGMENT, g)} as {n}" for g, n in ((1, "a"), (2, "b"), (3, "c"))]
    )
    return cut.where("b <> ''").selectExpr("id", "name", f"{code.segment_ok('a', 'b', 'c')} as ok")


# ---- value shapes ----------------------------------------------------------


def _register_shape(rule):
    pattern = duck.dq(duck.VALUE[rule.name])

    @query(
        f"shape_{rule.name}",
        f"select path, line_no, regexp_extract(line, {pattern}, 0) as value from {duck.TEXT_LINES} where regexp_matches(line, {pattern})",
    )
    def run(spark, folder):
        return shapes.lines_with_shape(text_lines(spark, folder), rule).select("path", "line_no", "value")


for _rule in RULES.values:
    _register_shape(_rule)


@query("detect_shapes", f"select path, line_no, key, rule, category, value, ord from ({duck.shape_findings(duck.TEXT_LINES)})")
def detect_shapes(spark, folder):
    return findings(shapes.detect_shapes(text_lines(spark, folder), MASKED), "path", "line_no").select(*FOUND, "ord")


@query("mask_all_matches", f"select path, line_no, out from ({duck.shape_out(duck.TEXT_LINES)}) where out <> line")
def mask_all_matches(spark, folder):
    return changed(shapes.detect_shapes(text_lines(spark, folder), MASKED), "path", "line_no", test="result.out <> line")


@query(
    "detect_fallback",
    f"select path, line_no, key, rule, category, value from ({duck.shape_findings(duck.TEXT_LINES, fv.FALLBACK_RULES, 'fallback:')})",
)
def detect_fallback(spark, folder):
    return findings(shapes.detect_fallback(text_lines(spark, folder), MASKED), "path", "line_no").select(*FOUND)


@query(
    "already_redacted_lines",
    f"select path, line_no, contains(out, '{fv.MASK}') as masked, regexp_matches(out, '<[A-Z_]+_[0-9]+>') or contains(out, '{fv.MASK}') as masked_or_token"
    f" from (select path, line_no, case when line_no % 2 = 0 then out else replace(out, '{fv.MASK}', '<URL_1>') end as out from ({duck.shape_out(duck.SHAPE)}))",
)
def already_redacted_lines(spark, folder):
    lines = shape_lines(spark, folder).withColumn("result", F.expr(shapes.shape_line("line", MASKED)))
    out = lines.selectExpr("path", "line_no", f"if(line_no % 2 = 0, result.out, replace(result.out, '{fv.MASK}', '<URL_1>')) as out")
    return out.selectExpr(
        "path", "line_no", f"{MASKED.already_redacted('out')} as masked", f"{TOKENS.already_redacted('out')} as masked_or_token"
    )


# ---- configuration lines ---------------------------------------------------


@query("detect_config", duck.config_all(CFG_AND_DOCS))
def detect_config(spark, folder):
    return findings(config.detect_config(cfg_and_docs(spark, folder), MASKED), "path", "line_no").select(*FOUND)


@query("mask_config_span", f"select path, line_no, out from ({duck.config_findings(duck.CFG)})")
def mask_config_span(spark, folder):
    return changed(config.detect_config(cfg_lines(spark, folder), MASKED), "path", "line_no")


@query("mask_yaml_values", f"select path, line_no, after, out from ({duck.config_findings(duck.CFG)}) where path like '%.y%ml'")
def mask_yaml_values(spark, folder):
    lines = cfg_lines(spark, folder).where("path like '%.y%ml'")
    return changed(config.detect_config(lines, MASKED), "path", "line_no", after="result.hits[0].after")


@query(
    "escape_xml_tokens",
    "select path, line_no, head || case when shape in ('xml_attr', 'xml_elem') then '&lt;' || category || '_N&gt;' else replace(after, 'TOKEN', '<' || category || '_N>') end || tail as out"
    f" from ({duck.config_findings(duck.CFG, "'TOKEN'")})",
)
def escape_xml_tokens(spark, folder):
    found = changed(config.detect_config(cfg_lines(spark, folder), TOKENS), "path", "line_no")
    return found.withColumn("out", F.expr(plain_marks("out")))


# ---- source code -----------------------------------------------------------


def _register_literals(name, lang, extension):
    lines = f"(select * from {duck.CODE} where path like '%.{extension}')"
    rules = [name] if name in duck.LANG_RULES[lang] else duck.LANG_RULES[lang]

    @query(f"literals_{name}", f"select path, line_no, category, value, out from ({duck.literal_findings(lines, rules)})")
    def run(spark, folder):
        wanted = code_lines(spark, folder).where(f"path like '%.{extension}'")
        ordinals = ", ".join(str(duck.LANG_RULES[lang].index(r) - 100) for r in rules)
        return (
            code.detect_literals(wanted, lang, MASKED).select("path", "line_no", "result.out", F.explode("result.hits").alias("h"))
            .where(f"h.ord in ({ordinals})").select("path", "line_no", "h.category", "h.value", "out")
        )


for _name, _lang, _ext in (
    ("java", "java", "java"), ("python_assign", "python", "py"), ("python_getenv", "python", "py"),
    ("javascript", "javascript", "ts"), ("go", "go", "go"), ("csharp", "csharp", "cs"),
    ("dart_assign", "dart", "dart"), ("dart_named", "dart", "dart"), ("dart_map", "dart", "dart"),
):
    _register_literals(_name, _lang, _ext)

# text lines under the name of a source file: literals first, then value shapes
CODE_AND_TEXT = (
    f"(select path, line_no, line from {duck.CODE} union all"
    f" select path || '.go' as path, line_no, line from {duck.TEXT_LINES})"
)


def code_and_text(spark, folder):
    texts = text_lines(spark, folder).withColumn("path", F.expr("concat(path, '.go')"))
    return code_lines(spark, folder).unionByName(texts)


CODE_REST = (
    f"(select t.path, t.line_no, coalesce(l.out, t.line) as line from {CODE_AND_TEXT} t left join"
    f" ({duck.code_literals(CODE_AND_TEXT)}) l on l.path = t.path and l.line_no = t.line_no)"
)
CODE_FOUND = (
    f"select path, line_no, key, rule, category, value from ({duck.code_literals(CODE_AND_TEXT)})"
    f" union all select path, line_no, key, rule, category, value from ({duck.shape_findings(CODE_REST, code=True)})"
)


@query("detect_code_lines", CODE_FOUND)
def detect_code_lines(spark, folder):
    return findings(code.detect_code_lines(code_and_text(spark, folder), MASKED), "path", "line_no").select(*FOUND)


@query("splice_code_literal", f"select path, line_no, out from ({duck.code_literals(duck.CODE)})")
def splice_code_literal(spark, folder):
    return changed(code.detect_code_lines(code_lines(spark, folder), MASKED), "path", "line_no")


# ---- whole text ------------------------------------------------------------

GO_CHAINS = [duck.GO_PLAIN, duck.GO_VAR, duck.GO_SHORT]
PY_FILES = f"(select * from {duck.BLOCKS} where path like '%.py')"
JAVA_FILES = f"(select * from {duck.BLOCKS} where path like '%.java')"
GO_FILES = f"(select * from {duck.BLOCKS} where path like '%.go')"


def _register_concat(name, files, patterns, first, style, extension):
    @query(name, duck.chain_findings(files, patterns, first))
    def run(spark, folder):
        found = blocks.detect_concat(block_files(spark, folder).where(f"path like '%.{extension}'"), style, MASKED)
        return findings(found, "path").withColumnRenamed("line", "line_no").select(*FOUND)


_register_concat("concat_paren", PY_FILES, [duck.PY_CHAIN], 1, blocks.PAREN, "py")
_register_concat("concat_plus", JAVA_FILES, [duck.PLUS_CHAIN], 0, blocks.PLUS, "java")
_register_concat("concat_go", GO_FILES, GO_CHAINS, 0, blocks.GO, "go")

ALL_CHAINS = " union all ".join(
    f"select path, name, joined, reason, category from ({duck.judged(f, p)})"
    for f, p in ((PY_FILES, [duck.PY_CHAIN]), (JAVA_FILES, [duck.PLUS_CHAIN]), (GO_FILES, GO_CHAINS))
)


@query("concat_verdicts", ALL_CHAINS)
def concat_verdicts(spark, folder):
    style = {"py": blocks.PAREN, "java": blocks.PLUS, "go": blocks.GO}
    cases = " ".join(f"when path like '%.{e}' then {blocks.chains('text', s.pattern, MASKED)}" for e, s in style.items())
    return (
        block_files(spark, folder).selectExpr("path", f"explode(case {cases} end) as c").where("c.fires")
        .selectExpr("path", "c.name", "c.joined", f"replace(c.rule, '{fv.CONCAT_RULE_PREFIX}', '') as reason", "c.category")
    )


def _masked_chain(pattern_list, files):
    span = "([\"''])[^\"''\\n]*([\"''])"
    return f"select path, regexp_replace(text, '{span}', '\\1{fv.MASK}\\2', 'g') as out from ({duck.judged(files, pattern_list)})"


MASKED_CHAINS = " union all ".join(
    _masked_chain(p, f) for f, p in ((PY_FILES, [duck.PY_CHAIN]), (JAVA_FILES, [duck.PLUS_CHAIN]), (GO_FILES, GO_CHAINS))
)


@query("rewrite_concat_masked", MASKED_CHAINS)
def rewrite_concat_masked(spark, folder):
    files = block_files(spark, folder).withColumn("kind", F.expr(paths.classify("path")))
    scanned = files.withColumn("result", F.expr(blocks.concat_for_kind("text", "kind", MASKED)))
    return changed(scanned, "path")


TOKEN_CHAINS = (
    "select path, replace(replace(text, parts[1], '<' || category || '_N>'), parts[2], '') as out from ("
    + " union all ".join(
        f"select path, text, parts, category from ({duck.judged(f, p)})"
        for f, p in ((PY_FILES, [duck.PY_CHAIN]), (JAVA_FILES, [duck.PLUS_CHAIN]), (GO_FILES, GO_CHAINS))
    ) + ")"
)


@query("rewrite_concat_tokens", TOKEN_CHAINS)
def rewrite_concat_tokens(spark, folder):
    files = block_files(spark, folder).withColumn("kind", F.expr(paths.classify("path")))
    scanned = files.withColumn("result", F.expr(blocks.concat_for_kind("text", "kind", TOKENS)))
    return changed(scanned, "path").withColumn("out", F.expr(plain_marks("out")))


PEM_FILES = f"(select * from {duck.BLOCKS} where path like '%.pem')"


@query(
    "detect_key_blocks",
    f"select path, 1 as line_no, cast(null as varchar) as key, 'fallback:private_key_block' as rule, 'PRIVATE_KEY' as category, m as value from ({duck.blocks(PEM_FILES)})",
)
def detect_key_blocks(spark, folder):
    found = blocks.detect_key_blocks(block_files(spark, folder).where("path like '%.pem'"), MASKED)
    return findings(found, "path").withColumnRenamed("line", "line_no").select(*FOUND)


MASKED_BLOCKS = (
    f"select path, replace(text, m, head || '{fv.MASK}' || regexp_replace(body, '[^\\n]+', '', 'g') || foot) as out from ({duck.blocks(PEM_FILES)})"
)


@query("rewrite_key_blocks", MASKED_BLOCKS)
def rewrite_key_blocks(spark, folder):
    found = blocks.detect_key_blocks(block_files(spark, folder).where("path like '%.pem'"), MASKED)
    return changed(found, "path")


# ---- whole scans -----------------------------------------------------------

# lines of the small files, by what handles them
FILE_LINES = f"(select path, line_no, line from {duck.FILES})"
_OF_KIND = "(select * from {lines} where {test})"
CONFIG_FILES = _OF_KIND.format(lines=FILE_LINES, test=f"{duck.kind('path')} = 'config'")
CODE_FILES = _OF_KIND.format(lines=FILE_LINES, test=f"starts_with({duck.kind('path')}, 'code:')")
OTHER_FILES = _OF_KIND.format(lines=FILE_LINES, test=f"{duck.kind('path')} is null")
TREE_FOUND = " union all ".join(
    f"select path, line_no, key, rule, category, value from ({x})"
    for x in (
        duck.config_all(CONFIG_FILES), duck.code_literals(CODE_FILES),
        duck.shape_findings(OTHER_FILES, fv.FALLBACK_RULES, "fallback:"),
        duck.chain_findings(PY_FILES, [duck.PY_CHAIN], 1), duck.chain_findings(JAVA_FILES, [duck.PLUS_CHAIN], 0),
        duck.chain_findings(GO_FILES, GO_CHAINS, 0),
        # a Go chain that is no finding leaves its first line to the literal rules
        duck.code_literals(
            f"(select b.path, 1 as line_no, string_split(b.text, chr(10))[1] as line from {GO_FILES} b"
            f" where b.path not in (select path from ({duck.judged(GO_FILES, GO_CHAINS)})))"
        ),
        f"select path, 1 as line_no, cast(null as varchar) as key, 'fallback:private_key_block' as rule, 'PRIVATE_KEY' as category, m as value from ({duck.blocks(PEM_FILES)})",
    )
)


@query("scan_tree", TREE_FOUND)
def scan_tree(spark, folder):
    return scan_findings(tree_files(spark, folder), MASKED).withColumnRenamed("line", "line_no").select(*FOUND)


# documents under names of every kind
DOC_TREE = """select concat(source, '/', lang, '/doc_', cast(doc_id as string), case doc_id % 12 when 0 then '.yaml' when 1 then '.properties' when 2 then '.json' when 3 then '.xml'
 when 4 then '.java' when 5 then '.py' when 6 then '.ts' when 7 then '.go' when 8 then '.cs' when 9 then '.md' when 10 then '.txt' else '' end) as path, text from {docs}"""
DUCK_DOC_TREE = (
    "(select path, unnest(ls) as line, cast(generate_subscripts(ls, 1) as int) as line_no from (select path, string_split(text, chr(10)) as ls from ("
    + DOC_TREE.format(docs="documents") + ")))"
)
_DOC_CODE = _OF_KIND.format(lines=DUCK_DOC_TREE, test=f"starts_with({duck.kind('path')}, 'code:')")
_DOC_CODE_REST = (
    f"(select t.path, t.line_no, coalesce(l.out, t.line) as line from {_DOC_CODE} t left join"
    f" ({duck.code_literals(_DOC_CODE)}) l on l.path = t.path and l.line_no = t.line_no)"
)
DOC_FOUND = " union all ".join(
    f"select path, line_no, key, rule, category, value from ({x})"
    for x in (
        duck.config_all(_OF_KIND.format(lines=DUCK_DOC_TREE, test=f"{duck.kind('path')} = 'config'")),
        duck.code_literals(_DOC_CODE), duck.shape_findings(_DOC_CODE_REST, code=True),
        duck.shape_findings(_OF_KIND.format(lines=DUCK_DOC_TREE, test=f"{duck.kind('path')} is null"), fv.FALLBACK_RULES, "fallback:"),
    )
)


def doc_tree(spark, folder):
    return as_files(spark.sql(DOC_TREE.format(docs="{docs}"), docs=dealt(table(spark, folder, "documents"))))


@query("scan_documents", DOC_FOUND)
def scan_documents(spark, folder):
    return scan_findings(doc_tree(spark, folder), MASKED).withColumnRenamed("line", "line_no").select(*FOUND)


FLAGSHIP = f"""select source, lang, rule, count(*) as n_findings, count(distinct value_hash) as n_values from
 (select split_part(path, '/', 1) as source, split_part(path, '/', 2) as lang, rule, sha256(value) as value_hash from ({duck.shape_findings(duck.DOC_LINES)})) group by all"""


@query("findings_per_source", FLAGSHIP)
def findings_per_source(spark, folder):
    """The minimum slice: shapes in documents per source, language and rule."""
    found = findings(shapes.detect_shapes(doc_lines(spark, folder), MASKED), "path")
    return (
        found.selectExpr("split_part(path, '/', 1) as source", "split_part(path, '/', 2) as lang", "rule", f"{tx.value_hash('value')} as value_hash")
        .groupBy("source", "lang", "rule")
        .agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("value_hash").alias("n_values"))
    )


# text of every file after masking
PLAIN_GO = (
    f"(select b.path, b.text, 1 as line_no, string_split(b.text, chr(10))[1] as line from {GO_FILES} b"
    f" where b.path not in (select path from ({duck.judged(GO_FILES, GO_CHAINS)})))"
)
_BLOCK_OUT = (
    f"select path, out as text from ({MASKED_CHAINS} union all {MASKED_BLOCKS} union all"
    f" select g.path, replace(g.text, g.line, l.out) from {PLAIN_GO} g join ({duck.code_literals(PLAIN_GO)}) l on l.path = g.path)"
)
TREE_OUT = " union all ".join([
    f"select path, 'top of file' || chr(10) || out || chr(10) as text from ({duck.config_findings(CONFIG_FILES)})",
    f"select path, 'top of file' || chr(10) || out || chr(10) as text from ({duck.shape_out(duck.NO_SETTING.format(duck.settings(CONFIG_FILES, True)))})",
    "select path, 'top of file' || chr(10) || line || chr(10) as text from"
    f" (select path, line_no, line from ({duck.settings(CONFIG_FILES)})) where path not in (select path from ({duck.config_findings(CONFIG_FILES)}))",
    f"select c.path, 'top of file' || chr(10) || coalesce(l.out, c.line) || chr(10) as text from {CODE_FILES} c left join ({duck.code_literals(CODE_FILES)}) l on l.path = c.path",
    f"select path, 'top of file' || chr(10) || out || chr(10) as text from ({duck.shape_out(OTHER_FILES, fv.FALLBACK_RULES)})",
    f"select b.path, coalesce(o.text, b.text) as text from {duck.BLOCKS} b left join ({_BLOCK_OUT}) o on o.path = b.path",
])


@query("sanitize_masked", TREE_OUT)
def sanitize_masked(spark, folder):
    return scan(tree_files(spark, folder), MASKED).selectExpr("path", "result.out as text")


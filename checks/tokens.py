"""Checks of typed placeholders."""

from __future__ import annotations

from maskwright import fixed_values as fv
from maskwright.operators import tokens as tok
from maskwright.operators.code import detect_code_lines
from maskwright.operators.config import detect_config
from maskwright.operators.hits import findings
from maskwright.operators.shapes import detect_shapes
from maskwright.plans.staging import sanitize
from maskwright.rules import value_rule_table
from maskwright.session import materialize

from . import duck
from .detection import CODE_FILES, CONFIG_FILES, GO_CHAINS, GO_FILES, JAVA_FILES, MASKED, OTHER_FILES, PEM_FILES, PLAIN_GO, PY_FILES, RULES, TOKENS
from .registry import cfg_lines, code_lines, query, text_lines, tree_files


@query(
    "categorize_findings",
    "select path, line_no, rule, case rule " + " ".join(f"when '{n}' then '{k}'" for n, _, k in fv.VALUE_RULES[:9])
    + f" else 'GENERIC_SECRET' end as category from ({duck.shape_findings(duck.TEXT_LINES)})",
)
def categorize_findings(spark, folder):
    """With a rule table that lacks some rules, which then get the default."""
    known = value_rule_table(spark, RULES).where("ord < 9").select("rule", "category")
    found = findings(detect_shapes(text_lines(spark, folder), MASKED), "path", "line_no").drop("category")
    return tok.categorize(found, known).select("path", "line_no", "rule", "category")


def found_values(spark, folder):
    """Token-mode findings of configuration and code lines."""
    cfg = findings(detect_config(cfg_lines(spark, folder), TOKENS), "path", "line_no")
    code = findings(detect_code_lines(code_lines(spark, folder), TOKENS), "path", "line_no")
    return cfg.unionByName(code).drop("line").withColumnRenamed("line_no", "line")


def walk(path: str) -> str:
    return f"(regexp_replace(regexp_replace({path}, '[^/]*$', ''), '([^/]+)/', '1\\1' || chr(1), 'g') || '0' || regexp_extract({path}, '[^/]*$', 0))"


def mark(category: str, value: str) -> str:
    digest = f"md5({category} || chr(1) || {value})"
    half = lambda a: f"lpad(cast(cast('0x' || substr({digest}, {a}, 16) as ubigint) as varchar), 20, '0')"
    return f"({half(1)} || {half(17)})"


VALUES = (
    f"(select path, line_no, category, {duck.identity('value')} as val, 0 as ord from ({duck.config_findings(duck.CFG)})"
    f" union all select path, line_no, category, value as val, ord from ({duck.code_literals(duck.CODE)}))"
)


def numbered(values: str) -> str:
    place = f"{walk('path')} || chr(1) || lpad(cast(line_no as varchar), 12, '0') || lpad(cast(ord + 500 as varchar), 5, '0')"
    return (
        "(select category, val, n_uses, row_number() over (partition by category order by f) as n,"
        " '<' || category || '_' || cast(row_number() over (partition by category order by f) as varchar) || '>' as token"
        f" from (select category, val, min({place}) as f, count(*) as n_uses from {values} group by category, val))"
    )


@query("number_tokens", f"select category, {mark('category', 'val')} as mark, n, token, n_uses from {numbered(VALUES)}")
def number_tokens(spark, folder):
    return tok.number_tokens(tok.token_uses(found_values(spark, folder)))


ASSIGNED = f"(select v.path, v.line_no as line, v.category, t.token from {VALUES} v join {numbered(VALUES)} t on t.category = v.category and t.val = v.val)"


def assigned(spark, folder):
    uses = materialize(tok.token_uses(found_values(spark, folder)), "uses")
    return tok.assign_tokens(uses, materialize(tok.number_tokens(uses).drop("category"), "numbers"))


@query("assign_tokens", f"select path, line, category, token from {ASSIGNED}")
def assign_tokens(spark, folder):
    return assigned(spark, folder).select("path", "line", "category", "token")


@query(
    "token_usage",
    f"select category, token, count(*) as n_uses, count(distinct path || chr(1) || cast(line as varchar)) as n_lines, count(distinct path) as n_files from {ASSIGNED} group by all",
)
def token_usage(spark, folder):
    return tok.token_usage(assigned(spark, folder))


# ---- whole files with tokens -----------------------------------------------


def marker(category: str, value: str) -> str:
    return f"('<' || {category} || '_' || {mark(category, value)} || '>')"


def xml(text: str) -> str:
    return f"replace(replace({text}, '<', '&lt;'), '>', '&gt;')"


def shape_tokens(lines: str, only=None, is_xml: str = "false") -> str:
    """One row per line of ``lines(path, line_no, line)``: out, with a marker for every
    match of every rule that fires, and uses, the matched texts in order."""
    rules = [(n, k) for n, _, k in fv.VALUE_RULES if only is None or n in only]
    sql, uses = f"(select *, line as cur0, {is_xml} as is_xml from {lines})", []
    for i, (name, category) in enumerate(rules):
        p = duck.dq(duck.VALUE[name])
        check = f"regexp_extract(cur{i}, {p}, {1 if name in duck.HAS_GROUP else 0})"
        new = marker(duck.dq(category), "v")
        woven = (
            f"array_to_string(list_transform(range(1, len(string_split_regex(cur{i}, {p})) + 1), lambda k: string_split_regex(cur{i}, {p})[k]"
            f" || coalesce(list_transform(u{i}, lambda v: case when is_xml then {xml(new)} else {new} end)[k], '')), '')"
        )
        sql = f"(select *, case when regexp_matches(cur{i}, {p}) and not {duck.is_dummy(check)} then regexp_extract_all(cur{i}, {p}) end as u{i} from {sql})"
        sql = f"(select *, case when u{i} is null then cur{i} else {woven} end as cur{i + 1} from {sql})"
        uses.append(f"coalesce(list_transform(u{i}, lambda v, k: struct_pack(ord := {i}, category := {duck.dq(category)}, val := v, pos := k)), [])")
    return f"select path, line_no, line, cur{len(rules)} as out, {duck_concat(uses)} as uses from {sql}"


def duck_concat(lists: list[str]) -> str:
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


_OWN = f"{duck.identity('value')}"
_SETTING_MARK = f"case when shape in ('xml_attr', 'xml_elem') then {xml(marker('category', _OWN))} else {marker('category', _OWN)} end"
_FREE = duck.NO_SETTING.format(duck.settings(CONFIG_FILES, True))
_CHAINS = [(PY_FILES, [duck.PY_CHAIN], 2), (JAVA_FILES, [duck.PLUS_CHAIN], 1), (GO_FILES, GO_CHAINS, 1)]
# the parts of a tree in token mode, with markers, in the order of a scan
_TREE = f"""
 settings as materialized ({duck.config_findings(CONFIG_FILES, _SETTING_MARK)}),
 shapes as materialized ({shape_tokens(_FREE, None, f"{duck.ext('path')} in {duck.words(fv.XML_EXTENSIONS)}")} union all {shape_tokens(OTHER_FILES, fv.FALLBACK_RULES)}),
 literals as materialized (select path, line_no, category, value, ord, replace(out, '{fv.MASK}', {marker('category', 'value')}) as out from ({duck.code_literals(CODE_FILES)})
   union all select path, line_no, category, value, ord, replace(out, '{fv.MASK}', {marker('category', 'value')}) from ({duck.code_literals(PLAIN_GO)})),
 chains as materialized ({" union all ".join(f"select path, text, parts, joined, category, {n} as line_no from ({duck.judged(f, p)})" for f, p, n in _CHAINS)}),
 keys as materialized (select *, 'PRIVATE_KEY' as category from ({duck.blocks(PEM_FILES)})),
 uses as materialized (select path, 1 as stage, line_no, 0 as ord, 1 as pos, category, {_OWN} as val from settings
   union all select path, 1, line_no, u.ord, u.pos, u.category, u.val from (select path, line_no, unnest(uses) as u from shapes)
   union all select path, 1, line_no, ord, 1, category, value from literals
   union all select path, 0, line_no, 0, 1, category, joined from chains
   union all select path, 0, 1, 0, 1, category, m from keys),
 numbers as materialized (select category, val, {mark('category', 'val')} as mark, row_number() over (partition by category order by f) as n from (
   select category, val, min({walk('path')} || chr(1) || stage || lpad(line_no::varchar, 12, '0') || lpad((ord + 500)::varchar, 5, '0') || lpad(pos::varchar, 5, '0')) as f from uses group by all)),
 known as materialized (select map_from_entries(list((mark, n))) as ns from numbers),
 marked as (select path, 'top of file' || chr(10) || out || chr(10) as text from settings
   union all select path, 'top of file' || chr(10) || out || chr(10) from shapes
   union all select path, case when path in (select path from {PLAIN_GO}) then (select replace(b.text, string_split(b.text, chr(10))[1], l.out) from {duck.BLOCKS} b where b.path = l.path)
     else 'top of file' || chr(10) || out || chr(10) end from literals l
   union all select path, replace(replace(text, parts[1], {marker('category', 'joined')}), parts[2], '') from chains
   union all select path, replace(text, m, head || {marker('category', 'm')} || regexp_replace(body, '[^\n]+', '', 'g') || foot) from keys)"""


def resolved(text: str) -> str:
    """With numbers in place of marker digits."""
    return (
        f"array_to_string(list_transform(range(1, len(string_split_regex({text}, '_[0-9]{{40}}')) + 1), lambda k: string_split_regex({text}, '_[0-9]{{40}}')[k]"
        f" || coalesce('_' || ns[regexp_extract_all({text}, '_([0-9]{{40}})', 1)[k]]::varchar, '')), '')"
    )


_EVERY_FILE = f"(select path, text from {duck.FILES} union all select path, text from {duck.BLOCKS})"


@query(
    "sanitize_tokens",
    f"with {_TREE} select f.path, case when m.text is null then f.text else {resolved('m.text')} end as text from {_EVERY_FILE} f left join marked m on m.path = f.path, known",
)
def sanitize_tokens(spark, folder):
    """All kinds of files: settings, value shapes inside each other, literals,
    concatenations, key blocks."""
    return sanitize(tree_files(spark, folder), TOKENS).files.select("path", "text")


@query(
    "token_findings",
    f"""with {_TREE}, found as (select path, line_no, category, {_OWN} as val from settings
   union all select path, line_no, u.category, u.val from (select path, line_no, unnest(list_filter(uses, lambda u: u.pos = 1)) as u from shapes)
   union all select path, line_no, category, value from literals
   union all select path, line_no, category, joined from chains
   union all select path, 1, category, m from keys)
 select path, line_no as line, f.category, '<' || f.category || '_' || n || '>' as token from found f join numbers n on n.category = f.category and n.val = f.val
 union all select path, line_no + i as line, category, '' from (select path, line_no, category, unnest(range(1, len(parts))) as i from chains)""",
)
def token_findings(spark, folder):
    found = sanitize(tree_files(spark, folder), TOKENS).findings
    return found.selectExpr("path", "line", "category", "regexp_extract(replace(replace(after, '&lt;', '<'), '&gt;', '>'), '<[A-Z_]+_[0-9]+>', 0) as token")

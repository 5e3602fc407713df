"""DuckDB SQL for what the Spark operators compute, written a second time.

RE2 has no look-around, so limits of words are consumed characters here.
"""

from __future__ import annotations

from maskwright import fixed_values as fv

from . import carriers as c

CFG = f"({c.for_duckdb(c.CFG_LINES)})"
SHAPE = f"({c.for_duckdb(c.SHAPE_LINES)})"
CODE = f"({c.for_duckdb(c.CODE_LINES)})"
BLOCKS = f"({c.for_duckdb(c.BLOCK_FILES)})"
FILES = f"({c.for_duckdb(c.LINE_FILES)})"
IDENTS = f"({c.for_duckdb(c.IDENTS)})"
CASES = f"({c.for_duckdb(c.CASES)})"
CASE_FILES = f"({c.for_duckdb(c.CASE_FILES)})"
SCORES = f"({c.for_duckdb(c.SCORES)})"
SCANS = f"({c.for_duckdb(c.SCANS)})"

MASK = fv.MASK


def dq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(dq(i) for i in items) + ")"


# documents, pages and shape lines as numbered lines
DOC_LINES = """(select path, unnest(ls) as line, cast(generate_subscripts(ls, 1) as int) as line_no from
 (select concat(source, '/', lang, '/doc_', cast(doc_id as string), '.txt') as path, string_split(text, chr(10)) as ls from documents))"""
PAGE_LINES = """(select path, unnest(ls) as line, cast(generate_subscripts(ls, 1) as int) as line_no from
 (select concat('page_', cast(page_id as string), '.html') as path, string_split(html, chr(10)) as ls from pages))"""
TEXT_LINES = f"""(select path, line_no, line from {DOC_LINES} union all select path, line_no, line from {PAGE_LINES}
 union all select path, line_no, line from {SHAPE})"""

VALUE = {name: "(?i)" + pattern for name, pattern, _ in fv.VALUE_RULES}
VALUE_CATEGORY = {name: category for name, _, category in fv.VALUE_RULES} | {"high_entropy": "GENERIC_SECRET"}
HAS_GROUP = ("ipv6_address", "generic_url", "bearer_token")


def bare(x: str) -> str:
    return f"trim(trim(trim({x}, ' ' || chr(9) || chr(10) || chr(13)), '\"'), chr(39))"


def is_dummy(x: str) -> str:
    return f"(lower({bare(x)}) in {words(fv.ALLOWLIST)})"


def entropy(x: str) -> str:
    return f"coalesce(list_aggregate(string_split({x}, ''), 'entropy'), 0)"


def high_entropy(x: str) -> str:
    b = bare(x)
    return f"(length({b}) >= 20 and not regexp_full_match({b}, '[A-Za-z\\s_\\-/:.]+') and round({entropy(b)}, 12) >= 3.5)"


def category_of_rule(x: str) -> str:
    return "case " + x + " " + " ".join(f"when '{r}' then '{k}'" for r, k in VALUE_CATEGORY.items()) + " else 'GENERIC_SECRET' end"


def first_rule(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, {dq(p)}) then '{n}'" for n, p in VALUE.items()) + " end"


def strict_hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {dq('(^|[^A-Za-z0-9])(?i:' + pattern + ')($|[^A-Za-z0-9])')})"


def camel_pattern(pattern: str) -> str:
    """A rule with ASCII case limits: a lower-case edge letter must not touch a
    lower-case letter, an upper-case one no upper-case letter."""
    a, mid, z = pattern[0], pattern[1:-1], pattern[-1]
    left = f"(?:(?:^|[^a-z]){a}|(?:^|[^A-Z]){a.upper()})"
    right = f"(?:{z}(?:$|[^a-z])|{z.upper()}(?:$|[^A-Z]))"
    return f"{left}(?i:{mid}){right}"


def camel_hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {dq(camel_pattern(pattern))})"


def any_hit(x: str, hit) -> str:
    return "(" + " or ".join(hit(x, p) for p, _ in fv.KEY_RULES) + ")"


def key_category(x: str, hit) -> str:
    named = " ".join(f"when {hit(x, p)} then '{k}'" for p, k in fv.KEY_RULES if k != fv.DEFAULT_CATEGORY)
    return f"case {named} else 'GENERIC_SECRET' end"


def ext(path: str) -> str:
    return f"lower(regexp_extract({path}, '[^/]\\.([^./]+)$', 1))"


def kind(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$', 0)"
    code = " ".join(f"when '{e}' then 'code:{lang}'" for e, lang in fv.CODE_EXTENSIONS)
    return (
        f"case when {name} = '.env' or starts_with({name}, '.env.') or {ext(path)} in {words(fv.CONFIG_EXTENSIONS)}"
        f" then 'config' else case {ext(path)} {code} end end"
    )


# ---- settings --------------------------------------------------------------

XML_ATTR = r"""(?i)^(\s*<[\w:.\-]+\s+[^>]*?\bkey\s*=\s*["']([^"']+)["'][^>]*?\bvalue\s*=\s*["'])([^"']*)(["'].*)$"""
XML_ELEM = r"^(\s*<([A-Za-z_][\w.\-]*)(?:\s[^>]*)?>)([^<]*)(</([A-Za-z_][\w.\-]*)>\s*)$"
JSON = r"""^(\s*"([^"]+)"\s*:\s*)(.*?)(,?\s*)$"""
BARE = r"^(\s*([A-Za-z0-9_.\-\[\]]+)\s*[:=]\s*)(.*)()$"
OPENER = r"^\s*(\{|\[|[|>][+-]?\d*)\s*$"
SHAPES = {"xml_attr": XML_ATTR, "xml_elem": XML_ELEM, "json": JSON, "bareword": BARE}


def part(shape: str, group: int, x: str = "line") -> str:
    return f"regexp_extract({x}, {dq(SHAPES[shape])}, {group})"


def fits(shape: str, x: str = "line") -> str:
    test = f"regexp_matches({x}, {dq(SHAPES[shape])})"
    return f"({test} and {part(shape, 2, x)} = {part(shape, 5, x)})" if shape == "xml_elem" else test


def settings_of(shape: str, lines: str) -> str:
    return f"select path, line_no, {part(shape, 2)} as key, {part(shape, 3)} as value from {lines} where {fits(shape)}"


def settings(lines: str, keep_all: bool = False) -> str:
    """All lines with shape, head, key, value, tail of their setting."""
    chosen = "case " + " ".join(
        f"when {fits(s)} and not regexp_matches({part(s, 3)}, {dq(OPENER)}) then '{s}'" for s in SHAPES
    ) + " end"

    def pick(group: int) -> str:
        return "case shape " + " ".join(f"when '{s}' then {part(s, group)}" for s in SHAPES) + " end"

    where = "" if keep_all else " where shape is not null"
    return (
        f"select *, {pick(1)} as head, {pick(2)} as key, {pick(3)} as value, {pick(4)} as tail"
        f" from (select *, {chosen} as shape from {lines}){where}"
    )


def quote_of(v: str) -> str:
    return f"case when regexp_matches(rtrim({v}), '(?s)^\".*\"$') and length(rtrim({v})) > 1 then '\"' when regexp_matches(rtrim({v}), '(?s)^''.*''$') and length(rtrim({v})) > 1 then chr(39) else '' end"


def identity(v: str) -> str:
    return f"case when {quote_of(v)} = '' then rtrim({v}) else substr(rtrim({v}), 2, length(rtrim({v})) - 2) end"


def wrap(v: str, new: str, force: str) -> str:
    return f"case when {quote_of(v)} = '' and {force} then '\"' || {new} || '\"' else {quote_of(v)} || {new} || {quote_of(v)} end"


def config_findings(lines: str, mask: str = f"'{MASK}'") -> str:
    """Findings on lines that hold a setting: path, line_no, key, rule, category,
    value, out."""
    checked = "case first " + " ".join(
        f"when '{n}' then regexp_extract(value, {dq(p)}, {1 if n in HAS_GROUP else 0})" for n, p in VALUE.items()
    ) + " else value end"
    rule = (
        f"case when {any_hit('key', strict_hit)} then 'key_name_match' when {is_dummy(checked)} then null"
        f" when first is not null then first when {high_entropy('value')} then 'high_entropy' end"
    )
    category = f"case rule when 'key_name_match' then {key_category('key', strict_hit)} else {category_of_rule('rule')} end"
    new = wrap("value", mask, f"{ext('path')} in ('yaml', 'yml')")
    return (
        f"select path, line_no, key, rule, category, value, head || {new} || tail as out, {new} as after, head, tail, shape from"
        f" (select *, {category} as category from (select *, {rule} as rule from (select *, {first_rule('value')} as first"
        f" from ({settings(lines)}) where trim(value, ' ' || chr(9)) <> '')) where rule is not null)"
    )


# ---- value shapes ----------------------------------------------------------


def shape_steps(lines: str, only=None, code: bool = False) -> str:
    """One row per line with the outcome of each rule: f<i> the first match where
    the rule fires, cur the rewritten text."""
    rules = [n for n, _, _ in fv.VALUE_RULES if only is None or n in only]
    sql = f"(select *, line as cur0 from {lines})"
    for i, name in enumerate(rules):
        p = dq(VALUE[name])
        first = f"regexp_extract(cur{i}, {p}, 0)"
        check = f"regexp_extract(cur{i}, {p}, 1)" if name in HAS_GROUP else first
        guard = f" and not contains({first}, '{MASK}')" if code else ""
        sql = f"(select *, case when regexp_matches(cur{i}, {p}) and not {is_dummy(check)}{guard} then {first} end as f{i} from {sql})"
        sql = f"(select *, case when f{i} is null then cur{i} else regexp_replace(cur{i}, {p}, '{MASK}', 'g') end as cur{i + 1} from {sql})"
    return sql


def shape_findings(lines: str, only=None, prefix: str = "", code: bool = False) -> str:
    rules = [n for n, _, _ in fv.VALUE_RULES if only is None or n in only]
    pick = ", ".join(
        f"struct_pack(ord := {i}, rule := '{prefix}{n}', category := '{VALUE_CATEGORY[n]}', value := f{i})" for i, n in enumerate(rules)
    )
    return (
        f"select path, line_no, cast(null as varchar) as key, h.rule as rule, h.category as category, h.value as value, h.ord as ord"
        f" from (select path, line_no, unnest([{pick}]) as h from {shape_steps(lines, only, code)}) where h.value is not null"
    )


def shape_out(lines: str, only=None, code: bool = False) -> str:
    n = len([x for x, _, _ in fv.VALUE_RULES if only is None or x in only])
    return f"select path, line_no, line, cur{n} as out from {shape_steps(lines, only, code)}"


NO_SETTING = "(select path, line_no, line from ({}) where shape is null)"


def config_all(lines: str) -> str:
    """Findings on all lines of configuration files."""
    free = NO_SETTING.format(settings(lines, True))
    return (
        f"select path, line_no, key, rule, category, value from ({config_findings(lines)})"
        f" union all select path, line_no, key, rule, category, value from ({shape_findings(free)})"
    )


# ---- source code -----------------------------------------------------------

KW = "password|secret|token|apikey|api_key|key|credential|auth"
_DART_LIT = r"""(?:r?"([^"\n]+)"|r?'([^'\n]+)')"""
LITERAL = {
    "java": rf'(?i)((?:String|final\s+String)\s+\w*)({KW})(\w*\s*=\s*")([^"]*)(")',
    "python_assign": rf"""(?i)(\w*)({KW})(\w*\s*=\s*["'])([^"']*)(["'])""",
    "python_getenv": rf"""(?i)((?:os\.getenv|os\.environ\.get)\(\s*["'][^"']*)({KW})([^"']*["']\s*,\s*["'])([^"']*)(["']\s*\))""",
    "javascript": rf"""(?i)((?:const|let|var)\s+\w*)({KW})(\w*\s*(?::\s*[^=;\n]+?)?\s*=\s*[`"'])(.*?)([`"'])""",
    "go": rf'(?i)(\w*)({KW})(\w*\s*:?=\s*")([^"]*)(")',
    "csharp": rf'(?i)((?:string|var)\s+\w*)({KW})(\w*\s*=\s*")([^"]*)(")',
    # quotes of both kinds as alternatives instead of look-behinds
    "dart_assign": rf"""(?i)((?:[A-Za-z_][\w.]*\??\s+)?\w*)({KW})(\w*\s*=\s*r?["'])([^"'\n]+)(["'])""",
    "dart_named": rf"""(?i)((?:^|[(,])\s*\w*)({KW})(\w*\s*:\s*r?["'])([^"'\n]+)(["'])""",
    "dart_map": rf"""(?i)(["']\w*)({KW})(\w*["']\s*:\s*r?["'])([^"'\n]+)(["'])""",
}
LANG_RULES = {
    "java": ["java"], "python": ["python_assign", "python_getenv"], "javascript": ["javascript"], "go": ["go"],
    "csharp": ["csharp"], "dart": ["dart_assign", "dart_named", "dart_map"],
}


def edge_ok(outside: str, inside: str) -> str:
    letter = f"regexp_matches({outside}, '[A-Za-z]')"
    lower = lambda x: f"regexp_matches({x}, '[a-z]')"
    return f"({outside} = '' or not {letter} or {lower(outside)} <> {lower(inside)})"


def segment_ok(before: str, word: str, after: str) -> str:
    return f"({edge_ok(f'right({before}, 1)', f'left({word}, 1)')} and {edge_ok(f'left({after}, 1)', f'right({word}, 1)')})"


def literal_findings(lines: str, rules) -> str:
    """First valid literal of each rule: path, line_no, value, category, out."""
    parts = []
    for i, name in enumerate(rules):
        p = dq(LITERAL[name])
        groups = ", ".join(f"regexp_extract_all(line, {p}, {g})" for g in range(1, 6))
        ok = segment_ok("m[1]", "m[2]", "m[3]")
        cat = "case lower(m[2]) " + " ".join(f"when '{w}' then '{k}'" for w, k in fv.CODE_KEYWORDS) + " else 'GENERIC_SECRET' end"
        parts.append(
            f"select path, line_no, m[4] as value, {cat} as category, {i} - 100 as ord,"
            f" replace(line, m[1] || m[2] || m[3] || m[4] || m[5], m[1] || m[2] || m[3] || '{MASK}' || m[5]) as out"
            f" from (select path, line_no, line, list_filter(list_zip({groups}), lambda m: {ok})[1] as m from {lines}"
            f" where regexp_matches(line, {p})) where m is not null and trim(m[4]) <> ''"
        )
    return " union all ".join(parts)


def code_literals(lines: str) -> str:
    """Literal findings of all languages, by the kind of the path."""
    return " union all ".join(
        f"select path, line_no, 'code_literal' as key, 'code_variable_pattern' as rule, category, value, ord, out"
        f" from ({literal_findings(f'(select * from {lines} where {kind('path')} = {dq('code:' + lang)})', rules)})"
        for lang, rules in LANG_RULES.items()
    )


# ---- whole text ------------------------------------------------------------

_S = r"[^\S\n]*"
_Q = r"""["'][^"'\n]*["']"""
PY_CHAIN = rf"""(?m)^{_S}([A-Za-z_]\w*){_S}={_S}\({_S}\n((?:{_S}{_Q}{_S}\n)+){_S}\){_S}$"""
_MOD = r"(?:[^\S\n]*(?:private|public|protected|static|final|readonly|const|let|var)[^\S\n]+)*"
PLUS_CHAIN = rf"""(?m)^{_MOD}[\w<>\[\], \t]*?(\w+){_S}={_S}({_Q}{_S}\+{_S}\n(?:{_S}{_Q}{_S}\+{_S}\n)*{_S}{_Q}{_S}(?:\+{_S})?;){_S}$"""
GO_PLAIN = rf"""(?m)^{_MOD}[\w<>\[\], \t]*?(\w+){_S}={_S}({_Q}{_S}\n(?:{_S}\+{_S}{_Q}{_S}\n)*{_S}\+{_S}{_Q}{_S};?){_S}$"""
GO_VAR = rf"""(?m)^{_S}var[^\S\n]+(\w+)[^\S\n]+[\w.\[\]*]+{_S}={_S}({_Q}{_S}\n(?:{_S}\+{_S}{_Q}{_S}\n)*{_S}\+{_S}{_Q}{_S};?){_S}$"""
GO_SHORT = rf"""(?m)^{_S}(\w+){_S}:={_S}({_Q}{_S}\n(?:{_S}\+{_S}{_Q}{_S}\n)*{_S}\+{_S}{_Q}{_S};?){_S}$"""
FRAGMENT = r"""["']([^"'\n]*)["']"""


def chains(files: str, patterns) -> str:
    """One row per file with a chain: path, name, parts, joined, first line."""
    name = "case " + " ".join(f"when regexp_matches(text, {dq(p)}) then regexp_extract(text, {dq(p)}, 1)" for p in patterns) + " end"
    body = "case " + " ".join(f"when regexp_matches(text, {dq(p)}) then regexp_extract(text, {dq(p)}, 2)" for p in patterns) + " end"
    return (
        f"select path, text, name, parts, array_to_string(parts, '') as joined from (select path, text, {name} as name,"
        f" regexp_extract_all({body}, {dq(FRAGMENT)}, 1) as parts from {files}) where name is not null"
    )


def judged(files: str, patterns) -> str:
    reason = (
        f"case when {any_hit('name', camel_hit)} then 'key_name_match' when {is_dummy('joined')} then null"
        f" when {first_rule('joined')} is not null then {first_rule('joined')} when {high_entropy('joined')} then 'high_entropy' end"
    )
    category = f"case when reason = 'key_name_match' then {key_category('name', camel_hit)} else {category_of_rule('reason')} end"
    return f"select *, {category} as category from (select *, {reason} as reason from ({chains(files, patterns)})) where reason is not null"


def chain_findings(files: str, patterns, first_line: int) -> str:
    return (
        f"select path, cast({first_line} + i as int) as line_no, name as key, 'multiline_concat_' || reason as rule, category, part as value"
        f" from (select path, name, reason, category, unnest(parts) as part, generate_subscripts(parts, 1) as i from ({judged(files, patterns)}))"
    )


BLOCK = (
    r"(?m)^([ \t]*[\"']?-----BEGIN [A-Z ]*PRIVATE KEY-----[\"']?[ \t]*\n)"
    r"((?:(?:[A-Za-z0-9+/]+=*|(?:Proc-Type|DEK-Info):[^\n]*)?\n)*)"
    r"([ \t]*[\"']?-----END [A-Z ]*PRIVATE KEY-----[\"']?[ \t]*\n?)?"
)


def blocks(files: str) -> str:
    p = dq(BLOCK)
    return (
        f"select * from (select path, text, regexp_extract(text, {p}, 0) as m, regexp_extract(text, {p}, 1) as head,"
        f" regexp_extract(text, {p}, 2) as body, regexp_extract(text, {p}, 3) as foot from {files} where regexp_matches(text, {p}))"
        f" where foot <> '' or replace(body, chr(10), '') <> ''"
    )

"""Detection on lines of configuration files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.text import Sql, let, q
from . import keys
from .hits import Context, hit, result, with_result
from .paths import extension
from .shapes import allowlist_text, category_of, first_rule, is_xml_file, shape_line


@dataclass(frozen=True)
class SettingShape:
    """A way to write key and value on one line.

    Groups: 1 all text before the value, 2 the key, 3 the value, 4 all text
    after it, so head + value + tail is the line again.
    """

    name: str
    pattern: str


# --- fixed values: the four ways to write a setting, in the order tried -----
SETTING_SHAPES = (
    SettingShape(
        "xml_attr",
        r"""(?iUd)^(\s*<[\w:.\-]+\s+[^>]*?\bkey\s*=\s*["']([^"']+)["'][^>]*?\bvalue\s*=\s*["'])([^"']*)(["'].*)$""",
    ),
    SettingShape(
        "xml_elem",
        r"(?Ud)^(\s*<([A-Za-z_][\w.\-]*)(?:\s[^>]*)?>)([^<]*)(</\2>\s*)$",
    ),
    SettingShape("json", r"""(?Ud)^(\s*"([^"]+)"\s*:\s*)(.*?)(,?\s*)$"""),
    SettingShape("bareword", r"(?Ud)^(\s*([A-Za-z0-9_.\-\[\]]+)\s*[:=]\s*)(.*)()$"),
)
# A value that only opens a structure: { or [ or a YAML block header.
OPENER = r"(?U)\A[\s\x1c-\x1f]*(?:\{|\[|[|>][+-]?\d*)[\s\x1c-\x1f]*\z"


def setting_as(line: Sql, shape: SettingShape) -> Sql:
    """The setting of a line in one shape, null if the line has another form.  The
    pattern covers the whole line; it runs once and writes marks between the
    groups."""
    named = lambda p: (
        f"named_struct('shape', {q(shape.name)}, 'head', {p(1)}, 'key', {p(2)}, 'value', {p(3)}, 'tail', {p(4)})"
    )
    fast = let(
        f"split({tx.sub(line, shape.pattern, tx.EDGE.join(f'${g}' for g in range(1, 5)))}, {q(tx.EDGE)}, -1)",
        lambda g: f"if(size({g}) < 4, null, {named(lambda n: f'get({g}, {n - 1})')})",
    )
    slow = f"if({tx.like(line, shape.pattern)}, {named(lambda n: tx.extract(line, shape.pattern, n))}, null)"
    return f"if({tx.marked(line)}, {slow}, {fast})"


def extract_setting(line: Sql) -> Sql:
    """First shape that fits and holds a leaf value."""
    leaves = [
        let(setting_as(line, s), lambda x: f"if({tx.like(f'{x}.value', OPENER)}, null, {x})")
        for s in SETTING_SHAPES
    ]
    # every shape has one of these characters
    return f"if({tx.like(line, '[:=<]')}, coalesce({', '.join(leaves)}), null)"


def settings_of_shape(lines: DataFrame, shape: SettingShape) -> DataFrame:
    """Lines that are written in one shape, with the parts of the setting."""
    return _with_parts(lines, setting_as("line", shape))


def extract_settings(lines: DataFrame) -> DataFrame:
    """``lines`` plus the parts of their setting; lines without one drop out."""
    return _with_parts(lines, extract_setting("line"))


def _with_parts(lines: DataFrame, setting: Sql) -> DataFrame:
    return (
        lines.withColumn("s", F.expr(setting)).where("s is not null")
        .select(*lines.columns, "s.shape", "s.head", "s.key", "s.value", "s.tail")
    )


def _verdict(setting: Sql, ctx: Context) -> Sql:
    """struct(rule, category) or null.  A key hit always wins; otherwise the
    allow-list, then the first value shape, then entropy."""
    rules, value = ctx.rules, f"{setting}.value"

    def by_value(name: Sql) -> Sql:
        checked = " ".join(
            f"when {name} = {q(r.name)} then {allowlist_text(value, r)}" for r in rules.values
        )
        checked = f"case {checked} else {value} end" if checked else value
        rule = f"coalesce({name}, if({tx.high_entropy(value)}, {q(fv.ENTROPY_RULE)}, null))"
        named = let(
            rule,
            lambda r: f"if({r} is null, null, named_struct('rule', {r}, 'category', {category_of(r, rules)}))",
        )
        return f"if({tx.is_dummy(checked, rules.allowlist)}, null, {named})"

    return let(
        keys.key_hits(f"{setting}.key", rules),
        lambda hits: f"if(size({hits}) > 0, named_struct('rule', {q(fv.KEY_NAME_RULE)}, 'category',"
        f" {keys.most_specific(f'{hits}.category')}), {let(first_rule(value, rules), by_value)})",
    )


def rebuild_span(setting: Sql, replacement: Sql) -> Sql:
    """The line with exactly the value span replaced."""
    return f"concat({setting}.head, {replacement}, {setting}.tail)"


def setting_replacement(setting: Sql, category: Sql, ext: Sql, ctx: Context) -> Sql:
    """Mask or token for a setting: keeps quotes, quotes bare YAML scalars, and
    escapes tokens inside XML."""
    new = ctx.replacement(category, tx.identity_value(f"{setting}.value"))
    if ctx.tokens:
        is_xml = tx.one_of(f"{setting}.shape", ("xml_attr", "xml_elem"))
        new = let(new, lambda t: f"if({is_xml}, {tx.xml_escaped(t)}, {t})")
    return let(new, lambda n: tx.wrap_quotes(f"{setting}.value", n, tx.one_of(ext, fv.YAML_EXTENSIONS)))


def config_line(line: Sql, path: Sql, ctx: Context) -> Sql:
    """Line result for a line of a configuration file."""
    ext = extension(path)

    def judged(setting: Sql) -> Sql:
        def emit(verdict: Sql) -> Sql:
            value = f"{setting}.value"
            suppress, changed = ctx.ignore_state(f"{verdict}.rule", f"{setting}.key", value)
            found = let(
                setting_replacement(setting, f"{verdict}.category", ext, ctx),
                lambda new: result(
                    rebuild_span(setting, new),
                    "array(" + hit(
                        key=f"{setting}.key", rule=f"{verdict}.rule", category=f"{verdict}.category",
                        value=value, after=new, changed=changed, uses=ctx.uses(tx.identity_value(value)),
                        ordinal=0,
                    ) + ")",
                ),
            )
            return f"if({verdict} is null or {suppress}, {result(line)}, {found})"

        return (
            f"case when {setting} is null then {shape_line(line, ctx, is_xml=is_xml_file(path))}"
            f" when {tx.is_blank(f'{setting}.value')} then {result(line)}"
            f" else {let(_verdict(setting, ctx), emit)} end"
        )

    return let(extract_setting(line), judged)


def detect_config(lines: DataFrame, ctx: Context) -> DataFrame:
    """``lines(path, line_no, line)`` of configuration files with their result."""
    return with_result(lines, config_line("line", "path", ctx))

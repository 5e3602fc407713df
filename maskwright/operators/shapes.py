"""Detection by value shape, and the rewriting that goes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.text import Sql, let, q
from ..rules import RuleSet, ValueRule
from .hits import LINE, Context, hit, result, with_result
from .paths import extension

# A text without the sign of a rule cannot match the rule.  A sign is one rare
# character and what must stand around it, so a search for any sign passes over
# ordinary text with one test per character.  (\u212A is the Kelvin sign, the one
# other character that equals a K when case is ignored.)
_SIGNS = {
    "ipv4_address": (".", r"(?<=\d\.)\d{1,3}\.\d"),
    "ipv6_address": (":", r"(?<=[0-9a-fA-F]:)[0-9a-fA-F]{1,4}:"),
    "url_with_credentials": (":", r"(?<=:)//"),
    "generic_url": (":", r"(?<=:)//"),
    "aws_access_key_id": (r"kK\u212A", r"(?<=[aA][kK\u212A]).[aA]"),
    "aws_secret_key_assignment": ("_", r"(?<=[cC][rR][eE][tT]_)[aA][cC][cC][eE]"),
    "github_token": ("_", r"(?<=[gG][hH]._)"),
    "slack_token": (r"\-", r"(?<=[xX][oO][xX].-)"),
    "jwt_token": ("jJ", r"(?<=[eE][yY][jJ])"),
    "bearer_token": ("bB", r"(?<=[bB])[eE][aA][rR][eE][rR]"),
    "private_key_block": (r"\-", r"(?<=-)----"),
    "email_address": ("@", r"(?<=@)"),
}
# fixed text to look for before the full pattern is tried
_PART = {"url_with_credentials": "://", "generic_url": "://", "private_key_block": "-----", "email_address": "@"}
_DEFAULT_PATTERN = {name: pattern for name, pattern, _ in fv.VALUE_RULES}


def _has_sign(rule: ValueRule) -> bool:
    return _DEFAULT_PATTERN.get(rule.name) == rule.pattern


def may_match(text: Sql, rules: RuleSet) -> Sql:
    """Cheap necessary condition for any value rule: one search for their signs."""
    if not rules.values:
        return "false"
    if not all(_has_sign(r) for r in rules.values):
        return "true"
    signs = [_SIGNS[r.name] for r in rules.values]
    pivots = "".join(dict.fromkeys(pivot for pivot, _ in signs))
    around = "|".join(dict.fromkeys(rest for _, rest in signs))
    return tx.like(text, f"(?Ud)[{pivots}](?:{around})")


def matches(text: Sql, rule: ValueRule) -> Sql:
    full = tx.like(text, rule.regex)
    if _has_sign(rule) and rule.name in _PART:
        return f"({tx.has(text, _PART[rule.name])} and {full})"
    return full


def first_rule(text: Sql, rules: RuleSet) -> Sql:
    """Name of the first value rule that matches, null if none does."""
    if not rules.values:
        return "cast(null as string)"
    cases = " ".join(f"when {matches(text, r)} then {q(r.name)}" for r in rules.values)
    return f"case when not {may_match(text, rules)} then null {cases} end"


def category_of(rule_name: Sql, rules: RuleSet) -> Sql:
    pairs = [(r.name, r.category) for r in rules.values]
    return tx.lookup(pairs, rule_name, fv.DEFAULT_CATEGORY) if pairs else q(fv.DEFAULT_CATEGORY)


def allowlist_text(text: Sql, rule: ValueRule) -> Sql:
    """What the allow-list is compared with for the first match of a rule."""
    groups = [tx.extract(text, rule.regex, g) for g in rule.allowlist_groups]
    if len(groups) < 2:
        return groups[0] if groups else tx.extract(text, rule.regex)
    return f"coalesce({', '.join(f'nullif({g}, {q(str())})' for g in groups)}, '')"


def mask_all(text: Sql, rule: ValueRule) -> Sql:
    """Every match in the text becomes the mask."""
    return tx.sub(text, rule.regex, fv.MASK)


# The fold carries less than a full finding; the rest follows from the ordinal.
_MINI = "array<struct<ord:int,category:string,value:string,changed:boolean,uses:array<string>>>"


def mini_start(line: Sql) -> Sql:
    return f"named_struct('out', {line}, 'hits', cast(array() as {_MINI}))"


def mini_add(acc: Sql, out: Sql, ordinal: int, category: Sql, value: Sql, changed: Sql, uses: Sql) -> Sql:
    return (
        f"named_struct('out', {out}, 'hits', concat({acc}.hits, cast(array(named_struct('ord', {ordinal},"
        f" 'category', {category}, 'value', {value}, 'changed', {changed}, 'uses', {uses})) as {_MINI})))"
    )


def token_text(category: Sql, value: Sql, ctx: Context, is_xml: Sql | None = None) -> Sql:
    token = ctx.replacement(category, value)
    if not ctx.tokens or is_xml is None:
        return token
    return let(token, lambda t: f"if({is_xml}, {tx.xml_escaped(t)}, {t})")


def reported_name(rule: ValueRule, is_fallback: bool) -> str:
    return (fv.FALLBACK_PREFIX if is_fallback else "") + rule.name


def shape_fold(
    start: Sql, ctx: Context, *, is_code: bool = False, is_fallback: bool = False, is_xml: Sql | None = None
) -> Sql:
    """Try the value rules in order on text that earlier rules have rewritten.

    A rule fires at most once: all its matches are replaced, the first is
    recorded, and only the first is compared with the allow-list.  In source code
    a match that already holds a replacement is left alone.
    """

    def step(ordinal: int, rule: ValueRule):
        category = q(rule.category)
        name = q(reported_name(rule, is_fallback))

        def fire(acc: Sql, first: Sql) -> Sql:
            suppress, changed = ctx.ignore_state(name, "null", first)
            checked = allowlist_text(f"{acc}.out", rule) if rule.allowlist_groups else first
            skip = [tx.is_dummy(checked, ctx.rules.allowlist)]
            if is_code:
                skip.append(ctx.already_redacted(first))
            if ctx.ignores:
                skip.append(suppress)
            if ctx.tokens:
                new = let(
                    tx.extract_all(f"{acc}.out", rule.regex),
                    lambda found: mini_add(
                        acc,
                        tx.splice_all(
                            f"{acc}.out", rule.regex,
                            tx.each(found, lambda v: token_text(category, v, ctx, is_xml)),
                        ),
                        ordinal, category, first, changed, found,
                    ),
                )
            else:
                new = mini_add(acc, mask_all(f"{acc}.out", rule), ordinal, category, first, changed, "null")
            return f"if({tx.either(skip)}, {acc}, {new})"

        def apply(acc: Sql) -> Sql:
            first = tx.extract(f"{acc}.out", rule.regex)
            return f"if({matches(f'{acc}.out', rule)}, {let(first, lambda f: fire(acc, f))}, {acc})"

        return apply

    return tx.fold(start, [step(ordinal, rule) for ordinal, rule in enumerate(ctx.rules.values)])


def finish(folded: Sql, ctx: Context, *, is_fallback: bool = False, is_xml: Sql | None = None) -> Sql:
    """Fold result to a line result with full findings.  Ordinals below zero are
    the literal rules of source code."""
    names = ", ".join(q(reported_name(r, is_fallback)) for r in ctx.rules.values)
    rules = f"array({names})" if names else "cast(array() as array<string>)"

    def full(h: Sql) -> Sql:
        return hit(
            rule=f"if({h}.ord < 0, {q(fv.CODE_RULE)}, get({rules}, {h}.ord))",
            key=f"if({h}.ord < 0, {q(fv.CODE_KEY)}, null)",
            category=f"{h}.category", value=f"{h}.value", changed=f"{h}.changed",
            after=token_text(f"{h}.category", f"{h}.value", ctx, is_xml),
            uses=f"{h}.uses" if ctx.tokens else "cast(null as array<string>)",
            ordinal=f"{h}.ord", stage=LINE,
        )

    return let(folded, lambda r: result(f"{r}.out", tx.each(f"{r}.hits", full)))


def shape_line(
    line: Sql, ctx: Context, *, is_fallback: bool = False, is_xml: Sql | None = None
) -> Sql:
    """Line result from the value rules; lines without any sign cost one test."""
    folded = shape_fold(mini_start(line), ctx, is_fallback=is_fallback, is_xml=is_xml)
    done = finish(folded, ctx, is_fallback=is_fallback, is_xml=is_xml)
    return f"if({may_match(line, ctx.rules)}, {done}, {result(line)})"


def is_xml_file(path: Sql) -> Sql:
    return tx.one_of(extension(path), fv.XML_EXTENSIONS)


def lines_with_shape(lines: DataFrame, rule: ValueRule, column: str = "line") -> DataFrame:
    """Lines that hold a value of this shape, with the first such value."""
    return lines.where(matches(column, rule)).withColumn("value", F.expr(tx.extract(column, rule.regex)))


def detect_shapes(lines: DataFrame, ctx: Context) -> DataFrame:
    """Value-rule results for ``lines(path, line)``; lines without any sign of a
    value are dropped before the rules run."""
    return with_result(
        lines.where(may_match("line", ctx.rules)), shape_line("line", ctx, is_xml=is_xml_file("path"))
    )


def detect_fallback(lines: DataFrame, ctx: Context) -> DataFrame:
    """Only the specific shapes, for text of no known kind."""
    narrow = ctx.narrow(*ctx.rules.fallback)
    return with_result(
        lines.where(may_match("line", narrow.rules)), shape_line("line", narrow, is_fallback=True)
    )


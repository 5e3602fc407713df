"""Detectors that look at a whole text: string concatenations over several
lines, and private-key blocks.  They keep the number of lines unchanged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.text import Sql, let, q
from . import keys
from .hits import NO_HITS, NO_USES, WHOLE_TEXT, Context, hit, result, with_result
from .shapes import category_of, first_rule

_S = r"[^\S\n]*"  # white space inside a line
_Q = r"""["'][^"'\n]*["']"""

# --- fixed values: how concatenations and key blocks are written ------------
_MODIFIERS = "private|public|protected|static|final|readonly|const|let|var"
_START = (
    rf"(?>(?:{_S}(?:{_MODIFIERS})[^\S\n]+)*[\w<>\[\],[^\S\n]]*?(\w+){_S}="
    rf"|{_S}var[^\S\n]+(\w+)[^\S\n]+[\w.\[\]*]+{_S}="
    rf"|{_S}(\w+){_S}:=){_S}{_Q}{_S}"
)
_MORE = rf"{_S}{_Q}{_S}\+{_S}\n"  # "text" +
_NEXT = rf"{_S}\+{_S}{_Q}{_S}"  # + "text"

# name = ( newline, quoted lines, )
CONCAT_PAREN = (
    rf"(?Udm)^{_S}([A-Za-z_]\w*)()(){_S}={_S}\({_S}\n(?:{_S}{_Q}{_S}\n)++{_S}\){_S}$"
)
# name = "a" + newline "b";   or   name = "a" newline + "b";
CONCAT_PLUS = (
    rf"(?Udm)^{_START}(?:\+{_S}\n(?:{_MORE})*+{_S}{_Q}{_S}(?:\+{_S})?;{_S}$"
    rf"|\n(?:{_NEXT}\n)*{_NEXT};{_S}$)"
)
# the same without a need for the semicolon
CONCAT_GO = (
    rf"(?Udm)^{_START}(?:\+{_S}\n(?:(?:{_MORE})*+{_S}{_Q}{_S}(?:(?:\+{_S})?;{_S}$|$|\+{_S}\z)|(?:{_MORE})++\z)"
    rf"|\n(?:{_NEXT}\n)*{_NEXT};?{_S}$)"
)
_KEY_LINE = r"(?-i:[A-Za-z0-9+/]+=*)|(?:Proc-Type|DEK-Info):[^\n]*"
_END_LINE = r"""[ \t]*["']?-----END [A-Z ]*PRIVATE KEY-----["']?[ \t]*"""
# groups: 1 BEGIN line, 2 key material, 3 END line or a last line without newline
KEY_BLOCK = (
    r"""(?iudm)^([ \t]*["']?-----BEGIN [A-Z ]*PRIVATE KEY-----["']?[ \t]*\n)"""
    rf"((?:(?:{_KEY_LINE})?\n)*+)"
    rf"({_END_LINE}(?:\n|\z)|(?:{_KEY_LINE})\z)?"
)

# cheap conditions, so that ordinary texts cost one short search
_MAY_PAREN = rf"(?Ud)={_S}\({_S}\n"
_MAY_PLUS = rf"""(?Ud)["']{_S}(?:\+{_S}\n{_S}["']|\n{_S}\+{_S}["'])"""


def located(text: Sql, pattern: str, *groups: int) -> Sql:
    """All matches with the number of their first line:
    array<struct(line, m, g0, g1, ...)>."""
    fields = "".join(f",g{i}:string" for i in range(len(groups)))
    item = f"struct<line:int,m:string{fields}>"
    extra = "".join(", " + tx.extract_all(text, pattern, g) for g in groups)
    acc, row = tx.fresh(), tx.fresh()
    copied = "".join(f", 'g{i}', {row}.g{i}" for i in range(len(groups)))
    rows = (
        f"cast(arrays_zip({tx.extract_all(text, pattern)}, split({text}, {q(pattern)}, -1){extra})"
        f" as array<struct<m:string,piece:string{fields}>>)"
    )
    start = f"cast({acc}.line + {tx.newline_count(f'{row}.piece')} as int)"
    step = let(
        start,
        lambda at: f"named_struct('line', cast({at} + {tx.newline_count(f'{row}.m')} as int), 'found',"
        f" concat({acc}.found, cast(array(named_struct('line', {at}, 'm', {row}.m{copied})) as array<{item}>)))",
    )
    # The text after the last match has no match of its own.
    named = tx.keep(rows, lambda r: f"{r}.m is not null")
    zero = f"named_struct('line', 1, 'found', cast(array() as array<{item}>))"
    return f"aggregate({named}, {zero}, ({acc}, {row}) -> {step}, {acc} -> {acc}.found)"


# ---- concatenations --------------------------------------------------------

_FRAGMENT = r"""["']([^"'\n]*)["']"""
_FRAGMENT_SPAN = r"""(["'])[^"'\n]*\1"""


def judge_concat(name: Sql, joined: Sql, ctx: Context) -> Sql:
    """struct(reason, category) for a joined value, null if it is harmless.
    The allow-list counts unless the name itself is suspicious."""
    rules = ctx.rules
    reason = f"coalesce({first_rule(joined, rules)}, if({tx.high_entropy(joined)}, {q(fv.ENTROPY_RULE)}, null))"
    by_value = let(
        reason,
        lambda r: f"if({r} is null or {tx.is_dummy(joined, rules.allowlist)}, null,"
        f" named_struct('reason', {r}, 'category', {category_of(r, rules)}))",
    )
    return let(
        keys.ident_hits(name, rules),
        lambda hits: f"if(size({hits}) > 0, named_struct('reason', {q(fv.KEY_NAME_RULE)}, 'category',"
        f" {keys.most_specific(f'{hits}.category')}), {by_value})",
    )


def chains(text: Sql, pattern: str, ctx: Context) -> Sql:
    """Each chain with its name, fragments, joined value and verdict."""

    def describe(m: Sql) -> Sql:
        def decided(x: Sql) -> Sql:
            return let(
                judge_concat(f"{x}.name", f"{x}.joined", ctx),
                lambda v: _chain(m, x, v, f"concat({q(fv.CONCAT_RULE_PREFIX)}, {v}.reason)", ctx),
            )

        return let(
            tx.extract_all(f"{m}.m", _FRAGMENT, 1),
            lambda parts: let(
                f"named_struct('name', concat({m}.g0, {m}.g1, {m}.g2), 'parts', {parts},"
                f" 'joined', array_join({parts}, ''))",
                decided,
            ),
        )

    return tx.each(located(text, pattern, 1, 2, 3), describe)


def _chain(m: Sql, x: Sql, verdict: Sql, rule: Sql, ctx: Context) -> Sql:
    suppress, changed = ctx.ignore_state(rule, f"{x}.name", f"{x}.joined")
    return (
        f"named_struct('line', {m}.line, 'm', {m}.m, 'name', {x}.name, 'parts', {x}.parts, 'joined', {x}.joined,"
        f" 'rule', {rule}, 'category', {verdict}.category, 'fires', {verdict} is not null and not {suppress},"
        f" 'changed', {changed})"
    )


def _new_fragment(chain: Sql, i: Sql, ctx: Context) -> Sql:
    """Mask on every fragment, or one token on the first and nothing on the rest."""
    if not ctx.tokens:
        return q(fv.MASK)
    return f"if({i} = 0, {tx.marker(f'{chain}.category', f'{chain}.joined')}, '')"


def chain_text(chain: Sql, first_line: int, ctx: Context) -> Sql:
    """The lines of a chain with each quoted fragment replaced."""
    lines = tx.each_at(
        f"split({chain}.m, '\\n', -1)",
        lambda line, i: f"regexp_replace({line}, {q(_FRAGMENT_SPAN)},"
        f" concat('$1', {_new_fragment(chain, f'({i} - {first_line})', ctx)}, '$1'))",
    )
    return f"if({chain}.fires, array_join({lines}, '\\n'), {chain}.m)"


def chain_hits(chain: Sql, first_line: int, ctx: Context) -> Sql:
    """One finding per fragment; the joined value counts once as a used value."""
    found = tx.each_at(
        f"{chain}.parts",
        lambda part, i: hit(
            line=f"{chain}.line + {first_line} + {i}", stage=WHOLE_TEXT, ordinal=0, key=f"{chain}.name",
            rule=f"{chain}.rule", category=f"{chain}.category", value=part,
            after=_new_fragment(chain, i, ctx), changed=f"{chain}.changed",
            uses=f"if({i} = 0, array({chain}.joined), {NO_USES})" if ctx.tokens else NO_USES,
        ),
    )
    return f"if({chain}.fires, {found}, {NO_HITS})"


@dataclass(frozen=True)
class Concat:
    """A style of concatenation; ``first_line`` is the line of the first fragment
    inside a match, ``may`` a cheap necessary condition."""

    pattern: str
    may: str
    first_line: int

    def text(self, text: Sql, ctx: Context) -> Sql:
        def build(found: Sql) -> Sql:
            new = tx.each(found, lambda c: chain_text(c, self.first_line, ctx))
            hits = f"flatten({tx.each(found, lambda c: chain_hits(c, self.first_line, ctx))})"
            return f"if(size({found}) = 0, {result(text)}, {result(tx.splice_all(text, self.pattern, new), hits)})"

        return f"if({tx.like(text, self.may)}, {let(chains(text, self.pattern, ctx), build)}, {result(text)})"


PAREN = Concat(CONCAT_PAREN, _MAY_PAREN, 1)
PLUS = Concat(CONCAT_PLUS, _MAY_PLUS, 0)
GO = Concat(CONCAT_GO, _MAY_PLUS, 0)

# --- fixed values: languages that join strings with + and end with ; --------
PLUS_LANGUAGES = ("java", "javascript", "csharp", "dart")


def concat_for_kind(text: Sql, kind: Sql, ctx: Context) -> Sql:
    """Result of the concatenation detector that fits the language of a file."""
    plus = tx.one_of(kind, [f"code:{x}" for x in PLUS_LANGUAGES])
    return (
        f"case when {kind} = 'code:python' then {PAREN.text(text, ctx)}"
        f" when {kind} = 'code:go' then {GO.text(text, ctx)}"
        f" when {plus} then {PLUS.text(text, ctx)} else {result(text)} end"
    )


# ---- key blocks ------------------------------------------------------------


def blocks_in(text: Sql) -> Sql:
    """Candidate blocks: array<struct(line, m, head, body, foot, real)>."""

    def block(m: Sql) -> Sql:
        def split_up(closed: Sql) -> Sql:
            body = f"if({closed}, {m}.g1, concat({m}.g1, {m}.g2))"
            return let(
                body,
                lambda b: f"named_struct('line', {m}.line, 'm', {m}.m, 'head', {m}.g0, 'body', {b},"
                f" 'foot', if({closed}, {m}.g2, ''), 'real', {closed} or replace({b}, '\\n', '') <> '')",
            )

        return let(tx.like(f"{m}.g2", "(?i)-----END "), split_up)

    return tx.each(located(text, KEY_BLOCK, 1, 2, 3), block)


def key_blocks(text: Sql, ctx: Context) -> Sql:
    """Result for a text.  BEGIN and END stay, the first body line becomes the mask
    and the others become empty.  Without an END the block reaches as far as lines
    look like key material, and a lone marker is no block."""
    rule, category = q(fv.FALLBACK_PREFIX + "private_key_block"), q("PRIVATE_KEY")

    def fires(b: Sql) -> Sql:
        suppress, _ = ctx.ignore_state(rule, "null", f"{b}.m")
        return f"({b}.real and not {tx.is_dummy(f'{b}.m', ctx.rules.allowlist)} and not {suppress})"

    def new_text(b: Sql) -> Sql:
        newlines = tx.sub(f"{b}.body", r"[^\n]+", "")
        masked = f"if({b}.body = '', '', concat({ctx.replacement(category, f'{b}.m')}, {newlines}))"
        return f"if({fires(b)}, concat({b}.head, {masked}, {b}.foot), {b}.m)"

    def found(b: Sql) -> Sql:
        _, changed = ctx.ignore_state(rule, "null", f"{b}.m")
        return hit(
            line=f"{b}.line", stage=WHOLE_TEXT, ordinal=0, rule=rule, category=category, value=f"{b}.m",
            after=ctx.replacement(category, f"{b}.m"), changed=changed, uses=ctx.uses(f"{b}.m"),
        )

    def build(blocks: Sql) -> Sql:
        return result(
            tx.splice_all(text, KEY_BLOCK, tx.each(blocks, new_text)),
            tx.each(tx.keep(blocks, fires), found),
        )

    has_marker = tx.like(text, "(?iu)-----BEGIN [A-Z ]*PRIVATE KEY-----")
    return f"if({has_marker}, {let(blocks_in(text), build)}, {result(text)})"


def detect_concat(files: DataFrame, style: Concat, ctx: Context) -> DataFrame:
    """``files(path, text)`` with the result of one style of concatenation."""
    return with_result(files, style.text("text", ctx))


def detect_key_blocks(files: DataFrame, ctx: Context) -> DataFrame:
    return with_result(files, key_blocks("text", ctx))

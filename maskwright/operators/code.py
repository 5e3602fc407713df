"""Suspicious variable = string literal, per language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.text import Sql, let, q
from ..rules import WORDS, LiteralRule
from . import keys
from .hits import Context, result, with_result
from .paths import classify
from .shapes import finish, may_match, mini_add, mini_start, shape_fold

LANGUAGES = tuple(fv.CODE_PATTERNS)
LITERAL_ORDINAL = -100  # literal rules come before the value rules

# The word between two marks is a whole part of the name: on each side comes the
# end, a character that is no letter, or a change of case.
_SEGMENT = (
    r"(?:\A|\P{L}|\p{IsLowercase}(?=\x01\P{IsLowercase})|[\p{L}&&\P{IsLowercase}](?=\x01\p{IsLowercase}))"
    r"\x01[^\x01]+"
    r"(?:\x01\z|\x01\P{L}|(?<=\p{IsLowercase})\x01[\p{L}&&\P{IsLowercase}]|(?<!\p{IsLowercase})\x01\p{IsLowercase})"
)


def segment_ok(before: Sql, word: Sql, after: Sql) -> Sql:
    """The word is set off inside its name: by the ends of the name, by a character
    that is no letter, or by a change of case."""
    return tx.like(f"concat(right({before}, 1), '\\u0001', {word}, '\\u0001', left({after}, 1))", _SEGMENT)


_PARTS = ("head", "word", "mid", "literal", "close")
_FOUND = "array<struct<" + ",".join(f"{p}:string" for p in _PARTS) + ">>"


def cut(line: Sql, rule: LiteralRule) -> Sql:
    """The line taken apart: struct(between, found), found holding the groups of
    each match and between the texts around the matches.

    The pattern is costly, so it runs once: a replacement writes marks around the
    groups, and the rest is cheap splitting at the marks.
    """
    groups = tx.GROUP.join(f"${g}" for g in range(1, 6))

    def named(g: Sql) -> Sql:
        fields = ", ".join(f"'{p}', get({g}, {i})" for i, p in enumerate(_PARTS))
        return f"named_struct({fields})"

    def pieces(p: Sql) -> Sql:
        # between and match alternate
        between = tx.keep_at(p, lambda _, i: f"{i} % 2 = 0")
        matches = tx.keep_at(p, lambda _, i: f"{i} % 2 = 1")
        found = tx.each(matches, lambda m: let(f"split({m}, {q(tx.GROUP)}, -1)", named))
        return f"named_struct('between', {between}, 'found', cast({found} as {_FOUND}))"

    def fast(m: Sql) -> Sql:
        nothing = f"named_struct('between', array({line}), 'found', cast(array() as {_FOUND}))"
        return f"if({m} = {line}, {nothing}, {let(f'split({m}, {q(tx.EDGE)}, -1)', pieces)})"

    extracts = ", ".join(tx.extract_all(line, rule.regex, g) for g in range(1, 6))
    slow = (
        f"named_struct('between', split({line}, {q(rule.regex)}, -1), 'found', cast(arrays_zip({extracts}) as {_FOUND}))"
    )
    return f"if({tx.marked(line)}, {slow}, {let(tx.sub(line, rule.regex, tx.EDGE + groups + tx.EDGE), fast)})"


def first_valid(found: Sql) -> Sql:
    """Position (from 0) of the first match whose word is a real name part, -1 if
    there is none."""
    flags = tx.each(found, lambda m: f"({m}.word = '' or {segment_ok(f'{m}.head', f'{m}.word', f'{m}.mid')})")
    return f"(cast(array_position({flags}, true) as int) - 1)"


def splice_literal(parts: Sql, at: Sql, new: Sql) -> Sql:
    """The line again, with only the literal of match number ``at`` replaced."""
    texts = tx.each_at(
        f"{parts}.found",
        lambda m, i: f"concat({m}.head, {m}.word, {m}.mid, if({i} = {at}, {new}, {m}.literal), {m}.close)",
    )
    return tx.weave(f"{parts}.between", texts)


def literal_fold(start: Sql, lang: str, ctx: Context) -> Sql:
    """Apply the literal rules of a language in order.  The allow-list plays no
    part: the name already is suspicious."""

    def step(ordinal: int, rule: LiteralRule):
        def fire(acc: Sql, parts: Sql, at: Sql, match: Sql) -> Sql:
            literal = f"{match}.literal"
            suppress, changed = ctx.ignore_state(q(fv.CODE_RULE), q(fv.CODE_KEY), literal)
            new = let(
                keys.keyword_category(f"{match}.word"),
                lambda category: mini_add(
                    acc,
                    let(ctx.replacement(category, literal), lambda n: splice_literal(parts, at, n)),
                    ordinal + LITERAL_ORDINAL, category, literal, changed,
                    f"array({literal})" if ctx.tokens else "null",
                ),
            )
            return f"if({match} is null or {tx.is_blank(literal)} or {suppress}, {acc}, {new})"

        def apply(acc: Sql) -> Sql:
            def chosen(parts: Sql) -> Sql:
                return let(
                    first_valid(f"{parts}.found"),
                    lambda at: let(f"get({parts}.found, {at})", lambda m: fire(acc, parts, at, m)),
                )

            return let(cut(f"{acc}.out", rule), chosen)

        return apply

    return tx.fold(start, [step(ordinal, rule) for ordinal, rule in enumerate(dict(ctx.rules.code).get(lang, ()))])


def has_word(line: Sql, ctx: Context) -> Sql:
    """Cheap necessary condition: a quote, and one of the words.  Rules that do not ask
    for a word leave no such condition."""
    if not all(rule.word for _, own in ctx.rules.code for rule in own):
        return "true"
    # a word that holds another one adds nothing
    words = WORDS.split("|")
    least = "|".join(w for w in words if not any(x != w and x in w for x in words))
    return f"({tx.like(line, '["`' + chr(39) + ']')} and {tx.like(line, f'(?iUd){least}')})"


def code_line(line: Sql, kind: Sql, ctx: Context) -> Sql:
    """Line result for a line of source code; ``kind`` is ``code:<language>``.

    Lines that were rewritten before are left alone as a whole, and most others end after
    a test for any word or sign.  Literal rules come first, value shapes after them.
    """

    def scanned(worded: Sql) -> Sql:
        def literals(acc: Sql) -> Sql:
            cases = " ".join(
                f"when {kind} = {q(f'code:{lang}')} then {literal_fold(acc, lang, ctx)}" for lang, own in ctx.rules.code if own
            )
            return f"case when not {worded} then {acc} {cases} else {acc} end"

        def shapes(acc: Sql) -> Sql:
            return f"if({may_match(f'{acc}.out', ctx.rules)}, {shape_fold(acc, ctx, is_code=True)}, {acc})"

        found = finish(let(let(mini_start(line), literals), shapes), ctx)
        return f"if(({worded} or {may_match(line, ctx.rules)}) and not {ctx.already_redacted(line)}, {found}, {result(line)})"

    return let(has_word(line, ctx), scanned)


def detect_code_lines(lines: DataFrame, ctx: Context) -> DataFrame:
    """``lines(path, line_no, line)`` of source files with their result."""
    return with_result(lines.withColumn("kind", F.expr(classify("path"))), code_line("line", "kind", ctx))


def detect_literals(lines: DataFrame, lang: str, ctx: Context) -> DataFrame:
    """Only the literal rules of one language."""
    folded = literal_fold(mini_start("line"), lang, ctx)
    return with_result(lines.where(has_word("line", ctx)), finish(folded, ctx))

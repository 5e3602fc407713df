"""Scalar functions on text, as Spark SQL expressions.

Every function takes and returns SQL text (``Sql``); the caller hands the
finished expression to ``F.expr`` / ``selectExpr``.  One parse in the JVM is far
cheaper than building the same tree node by node from Python, and all of it runs
on the JVM without Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import count

from .. import fixed_values as fv

Sql = str
_names = count(1)

SPACE = r"[\s\x1c-\x1f]"


def q(text: str) -> Sql:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fresh() -> str:
    return f"_x{next(_names)}"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Bind ``value`` to a name so that ``body`` may use it many times at the cost
    of one evaluation: the start of a fold over nothing, which is handed on as it is,
    while an array of one element would be built and its result copied at every level."""
    name, start = fresh(), fresh()
    return f"aggregate(array(), {value}, ({start}, {fresh()}) -> {start}, {name} -> {body(name)})"


def each(array: Sql, body: Callable[[Sql], Sql]) -> Sql:
    name = fresh()
    return f"transform({array}, {name} -> {body(name)})"


def each_at(array: Sql, body: Callable[[Sql, Sql], Sql]) -> Sql:
    """``body(element, position from 0)`` for each element."""
    name, at = fresh(), fresh()
    return f"transform({array}, ({name}, {at}) -> {body(name, at)})"


def keep(array: Sql, test: Callable[[Sql], Sql]) -> Sql:
    name = fresh()
    return f"filter({array}, {name} -> {test(name)})"


def keep_at(array: Sql, test: Callable[[Sql, Sql], Sql]) -> Sql:
    """The elements for which ``test(element, position from 0)`` holds."""
    name, at = fresh(), fresh()
    return f"filter({array}, ({name}, {at}) -> {test(name, at)})"


def fold(start: Sql, steps: Sequence[Callable[[Sql], Sql]]) -> Sql:
    """Apply the steps one after the other to ``start``.

    The steps are branches of one aggregate rather than nested in each other, so
    the depth of the expression does not grow with their number.
    """
    acc, at = fresh(), fresh()
    branches = " ".join(f"when {i} then {step(acc)}" for i, step in enumerate(steps))
    if not steps:
        return start
    if len(steps) == 1:
        return let(start, steps[0])
    return f"aggregate(sequence(0, {len(steps) - 1}), {start}, ({acc}, {at}) -> case {at} {branches} else {acc} end)"


def either(tests: Iterable[Sql]) -> Sql:
    return "(" + " or ".join(tests) + ")"


def one_of(value: Sql, words: Iterable[str]) -> Sql:
    return f"({value} in ({', '.join(q(w) for w in words)}))"


def like(text: Sql, pattern: str) -> Sql:
    return f"regexp_like({text}, {q(pattern)})"


def has(text: Sql, part: str) -> Sql:
    return f"contains({text}, {q(part)})"


def extract(text: Sql, pattern: str, group: int = 0) -> Sql:
    return f"regexp_extract({text}, {q(pattern)}, {group})"


def extract_all(text: Sql, pattern: str, group: int = 0) -> Sql:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def sub(text: Sql, pattern: str, new: str) -> Sql:
    return f"regexp_replace({text}, {q(pattern)}, {q(new)})"


def lookup(pairs: Iterable[tuple[str, str]], key: Sql, default: str | None = None) -> Sql:
    table = ", ".join(f"{q(k)}, {q(v)}" for k, v in pairs)
    found = f"try_element_at(map({table}), {key})"
    return found if default is None else f"coalesce({found}, {q(default)})"


def splice_all(text: Sql, pattern: str, new_texts: Sql) -> Sql:
    """Replace the n-th match of ``pattern`` by the n-th entry of ``new_texts``."""
    return weave(f"split({text}, {q(pattern)}, -1)", new_texts)


# Two characters that mark group limits while a text is taken apart.  Texts that
# hold one of them take a slower way, so they need no escaping.
EDGE, GROUP = "\x01", "\x02"


def marked(text: Sql) -> Sql:
    """The text already holds one of the marking characters."""
    return f"(contains({text}, {q(EDGE)}) or contains({text}, {q(GROUP)}))"


def weave(between: Sql, texts: Sql) -> Sql:
    """between[0] + texts[0] + between[1] + ... + between[n]."""
    a, b = fresh(), fresh()
    return f"array_join(zip_with({between}, concat({texts}, array('')), ({a}, {b}) -> concat({a}, {b})), '')"


def strip(text: Sql) -> Sql:
    """Without Unicode white space at both ends (``trim`` knows only U+0020)."""
    return sub(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Sql) -> Sql:
    return sub(text, rf"(?U){SPACE}+\z", "")


def is_blank(text: Sql) -> Sql:
    return like(text, rf"(?U)\A{SPACE}*\z")


def bare(text: Sql) -> Sql:
    """Without outer white space, then double quotes, then single quotes."""
    return extract(text, rf"""(?Us)\A{SPACE}*"*'*(.*?)'*"*{SPACE}*\z""", 1)


def is_dummy(text: Sql, allowlist: Sequence[str]) -> Sql:
    """The text is, as a whole, one of the allow-listed dummy words."""
    return one_of(f"lower({bare(text)})", allowlist) if allowlist else "false"


def entropy(text: Sql) -> Sql:
    """Shannon entropy in bits per character; 0 for empty text."""

    def of_text(t: Sql) -> Sql:
        shares = each(f"array_distinct(split({t}, ''))", lambda c: f"(length({t}) - length(replace({t}, {c}, ''))) / length({t})")
        acc, s = fresh(), fresh()
        return f"-aggregate({shares}, 0D, ({acc}, {s}) -> {acc} + {s} * log2({s}))"

    return f"if(length({text}) = 0, 0D, {let(text, of_text)})"


def high_entropy(text: Sql) -> Sql:
    """Long enough, not plain words with separators, and random-looking."""
    return let(
        bare(text),
        lambda t: f"(length({t}) >= {fv.ENTROPY_MIN_LENGTH}"
        f" and not {like(t, rf'(?U)\A{fv.ENTROPY_PLAIN_TEXT}\z')}"
        f" and round({entropy(t)}, 12) >= {fv.ENTROPY_MIN_BITS}D)",
    )


def _outer_quote(text: Sql) -> Sql:
    """The quote character that wraps the text on both sides (trailing white space
    aside), else ''."""
    return extract(text, rf"""(?Us)\A(["']).*\1{SPACE}*\z""", 1)


def identity_value(value: Sql) -> Sql:
    """The value without one matching pair of quotes: equal values compare equal
    however they were quoted."""
    return let(
        rstrip(value),
        lambda v: f"if({_outer_quote(v)} = '', {v}, substring({v}, 2, length({v}) - 2))",
    )


def wrap_quotes(value: Sql, replacement: Sql, force: Sql = "false") -> Sql:
    """Give ``replacement`` the quotes of ``value``; ``force`` adds quotes to a
    value that had none."""
    return let(
        _outer_quote(value),
        lambda c: f"""if({c} = '' and {force}, concat('"', {replacement}, '"'), concat({c}, {replacement}, {c}))""",
    )


def xml_escaped(token: Sql) -> Sql:
    return f"replace(replace({token}, '<', '&lt;'), '>', '&gt;')"


def value_hash(value: Sql) -> Sql:
    return f"sha2({value}, 256)"


def newline_count(text: Sql) -> Sql:
    return f"(length({text}) - length(replace({text}, '\\n', '')))"


def identity_digits(category: Sql, value: Sql) -> Sql:
    """128 bits of the (category, value) pair as 40 decimal digits."""
    return let(
        f"md5(concat({category}, '\\u0001', {value}))",
        lambda d: f"concat(lpad(conv(substring({d}, 1, 16), 16, 10), 20, '0'),"
        f" lpad(conv(substring({d}, 17, 16), 16, 10), 20, '0'))",
    )


def marker(category: Sql, value: Sql) -> Sql:
    """Stand-in for a token whose number is not known yet.

    It has the character classes of a real token (``<CATEGORY_digits>``), so
    patterns see both alike, and equal values get equal markers without any
    exchange between tasks.
    """
    return f"concat('<', {category}, '_', {identity_digits(category, value)}, '>')"

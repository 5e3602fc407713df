"""Key-name rules: which rules hit a configuration key or a code identifier."""

from __future__ import annotations

from collections.abc import Callable

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.text import Sql, q
from ..rules import CASELESS, KeyRule, RuleSet

# A configuration key part ends where no letter or digit follows.
_STRICT_BEFORE = r"(?<![\p{L}\p{N}])"
_STRICT_AFTER = r"(?![\p{L}\p{N}])"

# An identifier part also ends where the case changes.  Case matters inside the
# look-arounds only, hence (?-i:...).
_LOWER = r"\p{IsLowercase}"
_OTHER = r"[\p{L}&&[^\p{IsLowercase}]]"
_CAMEL_BEFORE = rf"(?-i:(?<!\p{{L}})|(?<={_LOWER})(?!{_LOWER})|(?<={_OTHER})(?={_LOWER}))"
_CAMEL_AFTER = rf"(?-i:(?!\p{{L}})|(?<!{_LOWER})(?={_LOWER})|(?<={_LOWER})(?={_OTHER}))"

NO_KEY_HITS = "cast(array() as array<struct<ord:int,category:string>>)"


def strict(rule: KeyRule) -> str:
    return f"{CASELESS}{_STRICT_BEFORE}(?:{rule.pattern}){_STRICT_AFTER}"


def camel(rule: KeyRule) -> str:
    return f"{CASELESS}{_CAMEL_BEFORE}(?:{rule.pattern}){_CAMEL_AFTER}"


def _hits(name: Sql, rules: RuleSet, bounded: Callable[[KeyRule], str]) -> Sql:
    """Ordered array of struct(ord, category) of the rules that hit; empty after a
    single test for names that hold none of the words."""
    if not rules.keys:
        return NO_KEY_HITS
    words = CASELESS + "|".join(f"(?:{r.pattern})" for r in rules.keys)
    tests = ", ".join(
        f"if({tx.like(name, bounded(r))}, named_struct('ord', {i}, 'category', {q(r.category)}), null)"
        for i, r in enumerate(rules.keys)
    )
    return f"if({tx.like(name, words)}, array_compact(array({tests})), {NO_KEY_HITS})"


def key_hits(key: Sql, rules: RuleSet) -> Sql:
    """Rules that hit a configuration key (strict word limits)."""
    return _hits(key, rules, strict)


def ident_hits(name: Sql, rules: RuleSet) -> Sql:
    """Rules that hit an identifier (case changes are limits too)."""
    return _hits(name, rules, camel)


def most_specific(categories: Sql) -> Sql:
    """First category that is not the default one, else the default."""
    named = tx.keep(categories, lambda c: f"{c} <> {q(fv.DEFAULT_CATEGORY)}")
    return f"coalesce(get({named}, 0), {q(fv.DEFAULT_CATEGORY)})"


def keyword_category(word: Sql) -> Sql:
    return tx.lookup(fv.CODE_KEYWORDS, f"lower({word})", fv.DEFAULT_CATEGORY)


"""The editable rule set: what to look for, in the order it is tried.

A rule set is small (tens of rows), lives on the driver and is unrolled into
column expressions at plan time, so every pattern reaches the executors as a
literal that is compiled once per task.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from . import fixed_values as fv

# Unicode classes, `$`/`.` that know only \n, and Unicode case folding.
CASELESS = "(?iUd)"


@dataclass(frozen=True)
class KeyRule:
    pattern: str
    category: str = fv.DEFAULT_CATEGORY


@dataclass(frozen=True)
class ValueRule:
    name: str
    pattern: str
    category: str = fv.DEFAULT_CATEGORY

    @property
    def regex(self) -> str:
        return CASELESS + self.pattern

    @property
    def allowlist_groups(self) -> tuple[int, ...]:
        """Groups whose text is compared with the allow-list: the one that closes
        last counts if it took part in the match, else the one before it.  Empty
        for patterns without groups, where the whole match counts."""
        closing, opened, number = [], [], 0
        for mark in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((\?(?!<[A-Za-z]))?|\)", self.pattern):
            if mark[0].startswith("("):
                plain = mark[1] is None
                number += plain
                opened.append(number if plain else 0)
            elif mark[0] == ")":
                closing.append(opened.pop())
        return tuple(g for g in reversed(closing) if g)


WORDS = "|".join(word for word, _ in fv.CODE_KEYWORDS)


@dataclass(frozen=True)
class LiteralRule:
    """A literal after a suspicious name in source code.

    Groups of ``regex``: 1 all before the word, 2 the word, 3 all between word and
    literal, 4 the literal, 5 what closes it.  A rule that does not name the words has
    an empty group 2 and takes every match.
    """

    name: str
    head: str
    word: str
    mid: str
    literal: str
    close: str

    @property
    def regex(self) -> str:
        return f"{CASELESS}({self.head})({self.word})({self.mid})({self.literal})({self.close})"

    @classmethod
    def of(cls, name: str, pattern: str) -> "LiteralRule":
        """A whole pattern, taken apart at the list of words and at its one group, which
        holds the literal."""
        opened = [m.start() for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?!\?)", pattern) if m[0] == "("]
        if len(opened) != 1:
            raise ValueError(f"code pattern {name} must have one group, around the literal")
        depth, end = 0, None
        for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[()]", pattern[opened[0] :]):
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if depth == 0 and m[0] == ")":
                end = opened[0] + m.start()
                break
        before, literal, close = pattern[: opened[0]], pattern[opened[0] + 1 : end], pattern[end + 1 :]
        head, found, mid = before.partition(f"(?:{WORDS})")
        return cls(name, head, WORDS, mid, literal, close) if found else cls(name, before, "", "", literal, close)


def literal_rules(patterns: dict[str, list]) -> tuple[tuple[str, tuple[LiteralRule, ...]], ...]:
    """Patterns per language, each a text or (name, text)."""
    named = lambda lang, i, p: p if isinstance(p, tuple) else (f"{lang}_{i + 1}", p)
    return tuple((lang, tuple(LiteralRule.of(*named(lang, i, p)) for i, p in enumerate(own))) for lang, own in patterns.items())


@dataclass(frozen=True)
class RuleSet:
    keys: tuple[KeyRule, ...]
    values: tuple[ValueRule, ...]
    allowlist: tuple[str, ...]
    fallback: frozenset[str] = field(default_factory=lambda: frozenset(fv.FALLBACK_RULES))
    code: tuple[tuple[str, tuple[LiteralRule, ...]], ...] = field(default_factory=lambda: literal_rules(fv.CODE_PATTERNS))

    def category_of_value_rule(self, name: str) -> str:
        for rule in self.values:
            if rule.name == name:
                return rule.category
        return fv.DEFAULT_CATEGORY

    def only(self, *names: str) -> "RuleSet":
        return replace(self, values=tuple(r for r in self.values if r.name in names))


def default_rules() -> RuleSet:
    return RuleSet(
        keys=tuple(KeyRule(p, c) for p, c in fv.KEY_RULES),
        values=tuple(ValueRule(n, p, c) for n, p, c in fv.VALUE_RULES),
        allowlist=tuple(fv.ALLOWLIST),
    )


def _java_dialect(pattern: str) -> str:
    """A Python pattern as Java reads it: named groups, the end of the text, and brackets
    and && inside classes are spelled differently; inline (?i) is implied."""
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)

    def respell(m: re.Match) -> str:
        if m[0] == r"\Z":
            return r"\z"
        if m[0][0] != "[":
            return m[0]
        start = 2 if m[0].startswith("[^") else 1
        body = m[0][start:-1]
        if body.startswith("]"):
            body = "\\" + body
        return m[0][:start] + re.sub(r"\\.|\[|&(?=&)", lambda x: x[0] if x[0][0] == "\\" else "\\" + x[0], body) + "]"

    return re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", respell, pattern).removeprefix("(?i)")


def _compiled(name: str, pattern: str) -> None:
    """Raise if Java can't read the pattern."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as error:
            raise ValueError(f"rule {name}: the pattern can't be used: {pattern}") from error


def _read(path: str) -> dict:
    """The sections of a rules file; empty ones are left out."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml  # the only use of this package
            except ImportError as error:
                raise ImportError(f"reading {path} needs the package pyyaml; rules can also be JSON") from error
            try:
                raw = yaml.safe_load(handle)
            except yaml.YAMLError as error:
                raise ValueError(f"{path} is no YAML: {error}") from error
        else:
            raw = json.load(handle)
    if not isinstance(raw or {}, dict):
        raise ValueError(f"{path} has no sections")
    return {section: body for section, body in (raw or {}).items() if body is not None}


def _texts(section: str, entries) -> list[str]:
    """A list of texts.  YAML reads words such as null, yes or 1.0 as something else."""
    if not isinstance(entries, list):
        raise ValueError(f"{section} must be a list")
    for entry in entries:
        if not isinstance(entry, str):
            raise ValueError(f"{section}: {entry!r} is no text; put it in quotes")
    return entries


def load_rules(path: str) -> RuleSet:
    """Read a rules file (JSON, or YAML with the package pyyaml).

    Keys: ``key_patterns`` (list), ``value_patterns`` (list of name/regex),
    ``code_patterns`` (lists by language), ``placeholder_allowlist`` (list).  Order is
    kept; a missing or empty section has no rules.  Patterns this package knows keep
    their category, unknown ones get the default.  A pattern that can't be used, and an
    entry that is no text, raise with their name.
    """
    raw = _read(path)
    key_category = dict(fv.KEY_RULES)
    value_category = {name: category for name, _, category in fv.VALUE_RULES}
    known = {p: name for own in fv.CODE_PATTERNS.values() for name, p in own}
    code = literal_rules({
        lang: [(known.get(p.removeprefix("(?i)"), f"{lang}_{i + 1}"), _java_dialect(p)) for i, p in enumerate(_texts(f"code_patterns {lang}", own or []))]
        for lang, own in raw.get("code_patterns", {}).items()
    })
    values = raw.get("value_patterns", [])
    for entry in values:
        if not isinstance(entry, dict) or not {"name", "regex"} <= entry.keys():
            raise ValueError(f"value_patterns: {entry!r} needs a name and a regex")
        _texts("value_patterns", [entry["name"], entry["regex"]])
    rules = RuleSet(
        code=code,
        keys=tuple(
            KeyRule(_java_dialect(p), key_category.get(p, fv.DEFAULT_CATEGORY))
            for p in _texts("key_patterns", raw.get("key_patterns", []))
        ),
        values=tuple(
            ValueRule(v["name"], _java_dialect(v["regex"]), value_category.get(v["name"], fv.DEFAULT_CATEGORY))
            for v in values
        ),
        allowlist=tuple(word.lower() for word in _texts("placeholder_allowlist", raw.get("placeholder_allowlist", []))),
    )
    for i, key in enumerate(rules.keys):
        _compiled(f"key_patterns {i + 1}", CASELESS + key.pattern)
    for rule in rules.values:
        _compiled(rule.name, rule.regex)
    for _, own in rules.code:
        for rule in own:
            _compiled(rule.name, rule.regex)
    return rules


def value_rule_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """Value rules as a table (ord, rule, category), for joins and zero counts."""
    rows = [(i, r.name, r.category) for i, r in enumerate(rules.values)]
    return spark.createDataFrame(rows, "ord int, rule string, category string")


def rule_state(spark: SparkSession, rules: RuleSet, tokens: bool) -> DataFrame:
    """All that a scan takes from its rules, as rows (section, ord, text, category)."""
    rows = [("key", i, r.pattern, r.category) for i, r in enumerate(rules.keys)]
    rows += [("value", i, f"{r.name} {r.pattern}", r.category) for i, r in enumerate(rules.values)]
    rows += [("allow", i, word, "") for i, word in enumerate(rules.allowlist)]
    rows += [(f"code {lang}", i, r.regex, "") for lang, own in rules.code for i, r in enumerate(own)]
    rows += [("fallback", 0, " ".join(sorted(rules.fallback)), ""), ("mode", 0, "tokens" if tokens else "mask", "")]
    return spark.createDataFrame(rows, "section string, ord int, text string, category string")

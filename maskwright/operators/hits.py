"""What a detection yields, and the settings every detector shares."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.text import Sql, q
from ..rules import RuleSet, default_rules
from .paths import Limits

# A finding inside its file.  `uses` holds the values that get a token in token
# mode, in order; `ord` orders the rules of one line.
HIT_TYPE = (
    "struct<line:int,stage:int,ord:int,key:string,rule:string,category:string,"
    "value:string,after:string,changed:boolean,uses:array<string>>"
)
HITS_TYPE = f"array<{HIT_TYPE}>"
NO_HITS = f"cast(array() as {HITS_TYPE})"
NO_USES = "cast(array() as array<string>)"

# whole-text detectors run before the line detectors
WHOLE_TEXT, LINE = 0, 1


@dataclass(frozen=True)
class Context:
    """How to scan: the rules, mask or typed tokens, and the file's ignores.

    ``ignores`` names a map column (see :func:`ignore_entry`) that holds only the
    entries of the file at hand, so a lookup costs no join per finding.  ``limits``
    says which files of no known kind are passed on unscanned.
    """

    rules: RuleSet
    tokens: bool = False
    ignores: Sql | None = None
    limits: Limits = Limits()

    def replacement(self, category: Sql, identity: Sql) -> Sql:
        return tx.marker(category, identity) if self.tokens else q(fv.MASK)

    def ignore_state(self, rule: Sql, key: Sql, value: Sql) -> tuple[Sql, Sql]:
        """(suppress, flag as changed) for a finding with this value."""
        if self.ignores is None:
            return "false", "false"
        entry = ignore_entry(rule, key)
        listed = f"coalesce(map_contains_key({self.ignores}, {entry}), false)"
        same = f"coalesce(try_element_at({self.ignores}, {entry}) = {tx.value_hash(value)}, false)"
        return f"({listed} and {same})", f"({listed} and not {same})"

    def already_redacted(self, text: Sql) -> Sql:
        masked = tx.has(text, fv.MASK)
        return f"({masked} or {tx.like(text, '(?Ud)' + fv.TOKEN_SHAPE)})" if self.tokens else masked

    def uses(self, *values: Sql) -> Sql:
        return f"array({', '.join(values)})" if self.tokens else NO_USES

    def narrow(self, *names: str) -> "Context":
        return replace(self, rules=self.rules.only(*names))


def mask_context(rules: RuleSet | None = None, ignores: Sql | None = None) -> Context:
    return Context(rules or default_rules(), False, ignores)


def token_context(rules: RuleSet | None = None, ignores: Sql | None = None) -> Context:
    return Context(rules or default_rules(), True, ignores)


def ignore_entry(rule: Sql, key: Sql) -> Sql:
    """Map key of an ignore inside one file; a null key is its own value."""
    return f"concat({rule}, '\\u0001', coalesce({key}, '\\u0002'))"


def hit(
    *, rule: Sql, category: Sql, value: Sql, after: Sql, changed: Sql, uses: Sql, ordinal: Sql | int,
    key: Sql = "cast(null as string)", line: Sql = "0", stage: int = LINE,
) -> Sql:
    return (
        f"named_struct('line', cast({line} as int), 'stage', {stage}, 'ord', {ordinal}, 'key', {key},"
        f" 'rule', {rule}, 'category', {category}, 'value', {value}, 'after', {after},"
        f" 'changed', {changed}, 'uses', {uses})"
    )


def result(out: Sql, hits: Sql = NO_HITS) -> Sql:
    """New text of a line or file with the findings in it."""
    return f"named_struct('out', {out}, 'hits', cast({hits} as {HITS_TYPE}))"


def with_result(table: DataFrame, expression: Sql) -> DataFrame:
    return table.withColumn("result", F.expr(expression))


def findings(scanned: DataFrame, *keep: str) -> DataFrame:
    """One row per finding of a ``result`` column, next to the kept columns.

    The outer form is on purpose: for the inner one Catalyst adds a filter on the
    array below the explode, and the detectors would run twice.
    """
    return (
        scanned.select(*keep, F.explode_outer("result.hits").alias("h")).where("h is not null").select(*keep, "h.*")
    )

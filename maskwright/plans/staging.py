"""Preview, apply, and the scan with typed tokens."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ignores as ign
from ..operators import paths
from ..operators import tokens as tok
from ..operators.hits import Context, findings
from ..rules import rule_state
from ..session import kept, materialize, new_folder, scratch
from ..sources.sinks import check_apart
from .scan import sanitize_masked, scan, scan_both

_OUT = "path string, kind string, reason string, text string, copied boolean, content binary"


@dataclass
class Sanitized:
    """files(path, kind, reason, text, copied, content), findings, and (in token mode)
    the token table, which holds marker digits and no values.  ``content`` is the bytes
    of copied files."""

    files: DataFrame
    findings: DataFrame
    tokens: DataFrame | None = None


def scan_once(files: DataFrame, ctx: Context, ignores: DataFrame | None = None) -> DataFrame:
    """The stored result of a scan: (path, kind, reason, text, hits, content).  Whatever
    is asked of a scan comes from here, so the detectors run once.  ``files`` may have a
    map of its ignores already (``ignores.attach``)."""
    if ignores is not None:
        files = ign.attach(files, ignores)
    if "ignores" in files.columns:
        ctx = replace(ctx, ignores="ignores")
    part = [c for c in ("part", "parts") if c in files.columns]
    done = scan(files, ctx).selectExpr("path", *part, "kind", "reason", "result.out as text", "result.hits as hits", "content")
    return materialize(done, "scanned")


def sanitized(scanned: DataFrame, tokens: bool, store=lambda df: materialize(df, "resolved")) -> Sanitized:
    """Files and findings of a stored scan.

    Token mode numbers the values seen in the files that have findings (usually few) and
    puts the numbers in, in texts and findings alike; the other files pass through
    untouched.  What comes of it is stored once.
    """
    part = [c for c in ("part", "parts") if c in scanned.columns]
    as_file = ("path", *part, "kind", "reason", "text", "reason is not null as copied", "content")
    if not tokens:
        return Sanitized(scanned.selectExpr(*as_file), _exploded(scanned))
    numbers = materialize(tok.number_tokens(tok.token_uses(_exploded(scanned))), "token-numbers")
    own = "concat(path, '\u0001', part)" if part else "path"
    hit = scanned.where("size(hits) > 0").selectExpr("path", *part, "kind", "text", "hits", f"{own} as own")
    changed = tok.resolve(hit, "own", ["text"], numbers, "hits").selectExpr(
        "path", *part, "kind", "cast(null as string) as reason", "text", "false as copied", "cast(null as binary) as content", "hits"
    )
    clean = scanned.where("size(hits) = 0").selectExpr(*as_file, "hits")
    done = store(changed.unionByName(clean))
    return Sanitized(done.drop("hits"), _exploded(done), numbers)


def _exploded(table: DataFrame) -> DataFrame:
    return table.select("path", F.explode("hits").alias("h")).select("path", "h.*")


def _without_values(table: DataFrame) -> DataFrame:
    """Findings with hashes in place of values."""
    fields = ("line", "stage", "ord", "key", "rule", "category", "after", "changed")
    safe = tx.each("hits", lambda h: "named_struct(" + ", ".join(f"'{f}', {h}.{f}" for f in fields) + f", 'value_hash', {tx.value_hash(f'{h}.value')})")
    return table.withColumn("hits", F.expr(safe))


def sanitize(files: DataFrame, ctx: Context, ignores: DataFrame | None = None) -> Sanitized:
    """Sanitize a corpus, leaving ignored findings as they are.

    Mask mode is lazy, one pass over the rows without any exchange for either result.
    Token mode scans once and stores its results; the scan itself, which holds values,
    is deleted, and so findings have ``value_hash`` in place of values.
    """
    if ctx.tokens:
        with scratch(files.sparkSession):
            done = sanitized(scan_once(files, ctx, ignores), True, lambda df: kept(_without_values(df), "sanitized"))
            return Sanitized(done.files, done.findings, kept(done.tokens, "tokens"))
    if ignores is not None:
        files, ctx = ign.attach(files, ignores), replace(ctx, ignores="ignores")
    return Sanitized(sanitize_masked(files, ctx), findings(scan(files, ctx), "path"))


@dataclass
class Stage:
    """A preview: where the output lies until it is applied, and the state it was
    computed for."""

    folder: str
    fingerprint: DataFrame
    newly_unredacted: DataFrame
    input_root: str | None = None


def scan_with_ignores(files: DataFrame, ignores: DataFrame, ctx: Context) -> DataFrame:
    return scan(ign.attach(files, ignores), replace(ctx, ignores="ignores"))


def unredacted_by_ignores(files: DataFrame, ignores: DataFrame, ctx: Context) -> DataFrame:
    """Places that only the ignore list leaves readable.  Only files that have an
    ignore can differ, so only those are scanned, both ways in one pass; the places that
    it finds, which hold no values, are stored."""
    both = scan_both(ign.attach(files, ignores, "inner"), ctx, replace(ctx, ignores="ignores"), "path")
    found = " , ".join(tx.each(f"{r}.hits", lambda h: f"named_struct('key', {h}.key, 'rule', {h}.rule, 'with_ignores', {w})") for r, w in (("one", "false"), ("other", "true")))
    places = both.selectExpr("path as file", f"inline_outer(flatten(array({found})))").where("rule is not null")
    places = materialize(places, "places")
    return ign.newly_unredacted(places.where("not with_ignores"), places.where("with_ignores"))


def state_of(ignores: DataFrame, excluded: DataFrame, ctx: Context) -> DataFrame:
    """Fingerprint of all that decides an output besides the files: the ignore list, the
    exclusions, and the rules and mode that the scan really uses."""
    return ign.state_fingerprint(ignores, excluded, rule_state(ignores.sparkSession, ctx.rules, ctx.tokens))


def stage(
    spark: SparkSession, files: DataFrame, ignores: DataFrame, excluded: DataFrame, ctx: Context, input_root: str | None = None,
) -> Stage:
    """Compute the output of all files that are not excluded into a staging folder; the
    target is not touched."""
    chosen = paths.exclude(files, excluded)
    folder = new_folder(spark, "stage")
    with scratch(spark):
        done = sanitized(scan_once(chosen, ctx, ignores), True) if ctx.tokens else sanitize(chosen, ctx, ignores)
        done.files.write.parquet(folder)
    return Stage(folder, materialize(state_of(ignores, excluded, ctx), "state"), unredacted_by_ignores(chosen, ignores, ctx), input_root)


def apply_stage(spark: SparkSession, staged: Stage, state_now: DataFrame, output: str) -> None:
    """Promote a preview, unless what it was computed from has changed since, or the
    target lies in the input."""
    if staged.input_root is not None:
        check_apart(spark, output, staged.input_root)
    if ign.is_stale(staged.fingerprint, state_now).first()["stale"]:
        raise RuntimeError("the preview is out of date: ignores, exclusions or rules have changed")
    spark.read.schema(_OUT).parquet(staged.folder).write.mode("error").parquet(output)

"""The whole scan: files in, findings and sanitized text out.

Everything up to the findings is local to a row: a corpus is read once, no file
is shuffled, and files of all kinds are handled in the same pass.  Typed tokens
need one exchange of *findings* (never of the corpus) to be numbered, see
``tokens.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import Sql, let, q
from ..operators import paths
from ..operators.blocks import concat_for_kind, key_blocks
from ..operators.code import code_line
from ..operators.config import config_line
from ..operators.hits import HITS_TYPE, Context, findings, hit, result
from ..operators.shapes import may_match, shape_line


def _scan_lines(text: Sql, early: Sql, line_result) -> Sql:
    """Run a line detector over all lines and put the text together again.
    ``early`` are the findings of the whole-text detectors."""

    def numbered(hits: Sql, at: Sql) -> Sql:
        fields = ("stage", "key", "rule", "category", "value", "after", "changed", "uses")
        return tx.each(
            hits,
            lambda h: hit(line=f"{at} + 1", ordinal=f"{h}.ord", **{f: f"{h}.{f}" for f in fields}),
        )

    def build(lines: Sql) -> Sql:
        out = f"array_join({lines}.out, '\\n')"
        hits = tx.each_at(lines, lambda x, i: numbered(f"{x}.hits", i))
        return result(out, f"concat(cast({early} as {HITS_TYPE}), cast(flatten({hits}) as {HITS_TYPE}))")

    return let(tx.each(f"split({text}, '\\n', -1)", line_result), build)


def whole_text_result(ctx: Context) -> Sql:
    """Findings that span lines: concatenations in source code, key blocks in files
    of no kind."""
    return (
        f"case when reason is not null or kind = 'config' then {result('text')}"
        f" when kind is not null then {concat_for_kind('text', 'kind', ctx)} else {key_blocks('text', ctx)} end"
    )


def line_results(ctx: Context) -> Sql:
    """Line detectors on the text that the whole-text detectors left."""
    narrow = ctx.narrow(*ctx.rules.fallback)
    config = _scan_lines("early.out", "early.hits", lambda l: config_line(l, "path", ctx))
    code = _scan_lines("early.out", "early.hits", lambda l: code_line(l, "kind", ctx))
    other = _scan_lines("early.out", "early.hits", lambda l: shape_line(l, narrow, is_fallback=True))
    return (
        f"case when reason is not null then early when kind = 'config' then {config}"
        f" when kind is not null then {code}"
        f" when {may_match('early.out', narrow.rules)} then {other} else early end"
    )


def with_kind(files: DataFrame, limits: paths.Limits = paths.Limits()) -> DataFrame:
    """Add kind and the reason not to scan a file, if there is one."""
    reason = paths.unscanned_reason("path", "length", "content", limits, "kind")
    if "known_reason" in files.columns:  # found out for a whole file, of which this may be a part
        reason = f"coalesce(known_reason, {reason})"
    return files.withColumn("kind", F.expr(paths.classify("path"))).withColumn("reason", F.expr(reason))


#: Stands before a part that begins inside a key block, and a line after all parts but
#: the last, so that no detector takes a part's end for the end of the file.
BLOCK_GOES_ON = "-----BEGIN PRIVATE KEY-----\n"
FILE_GOES_ON = "."


def placed_in_file(scanned: Sql) -> Sql:
    """The result for a part of a file: lines count from the file's beginning (as far as
    an integer goes), and lines put around the part are gone again."""
    fields = ("stage", "ord", "key", "rule", "category", "value", "after", "changed", "uses")
    shift = "lines_before - if(inside, 1, 0)"
    moved = tx.each(
        f"{scanned}.hits",
        lambda h: f"named_struct('line', cast(least({h}.line + {shift}, 2147483647L) as int), " + ", ".join(f"'{f}', {h}.{f}" for f in fields) + ")",
    )
    out = let(
        f"if(inside, substring({scanned}.out, instr({scanned}.out, '\\n') + 1), {scanned}.out)",
        lambda o: f"if(goes_on, substring({o}, 1, length({o}) - {len(FILE_GOES_ON)}), {o})",
    )
    return f"if(lines_before = 0 and not inside and not goes_on, {scanned}, {result(out, moved)})"


def scan(files: DataFrame, ctx: Context) -> DataFrame:
    """``files(path, text, length, content)`` to
    (path, kind, reason, text, result<out, hits>, content).

    Parts of a file (``parts.read_files``) give findings with the file's line numbers.
    Unscanned files keep their text and have no findings; ``content`` is the bytes of
    such files, to be passed on as they are, and null for all others.  If the context names
    an ignore column, ``files`` must carry it (see ``ignores.attach``).
    """
    keep = [c for c in files.columns if c not in ("text", "length", "content", "known_reason", "lines_before", "inside", "goes_on")]
    in_parts = "lines_before" in files.columns
    if in_parts:
        files = files.withColumn("goes_on", F.expr("coalesce(part < parts - 1 and endswith(text, '\\n'), false)"))
        around = f"concat(if(inside, {q(BLOCK_GOES_ON)}, ''), text, if(goes_on, {q(FILE_GOES_ON)}, ''))"
        files = files.withColumn("text", F.expr(f"if(inside or goes_on, {around}, text)"))
    found = let(line_results(ctx), placed_in_file) if in_parts else line_results(ctx)
    return (
        with_kind(files, ctx.limits)
        .withColumn("early", F.expr(whole_text_result(ctx)))
        .withColumn("result", F.expr(found))
        .select(*keep, "kind", "reason", "text", "result", F.expr("if(reason is not null, content, null) as content"))
    )


def scan_both(files: DataFrame, one: Context, other: Context, *keep: str) -> DataFrame:
    """Whole files scanned two ways in one pass: (``keep``, one, other), the results."""
    def scanned(table: DataFrame, ctx: Context, name: str) -> DataFrame:
        return table.withColumn("early", F.expr(whole_text_result(ctx))).withColumn(name, F.expr(line_results(ctx)))

    return scanned(scanned(with_kind(files, one.limits), one, "one"), other, "other").select(*keep, "one", "other")


def rows_where(scanned: DataFrame, test: Sql, **columns: Sql) -> DataFrame:
    """Rows of a scan that pass a test on its result.

    A plain filter would be pushed below the projection and run the detectors a
    second time; a generator is a barrier for that.
    """
    fields = ", ".join(f"{e} as {n}" for n, e in columns.items())
    first = next(iter(columns))
    return scanned.selectExpr(f"inline_outer(if({test}, array(struct({fields})), null))").where(f"{first} is not null")


def scan_findings(files: DataFrame, ctx: Context) -> DataFrame:
    """One row per finding of the whole corpus."""
    return findings(scan(files, ctx), "path")


def sanitize_masked(files: DataFrame, ctx: Context) -> DataFrame:
    """(path, kind, reason, text, copied, content) with every finding masked: a
    map-only job."""
    return scan(files, ctx).selectExpr(
        "path", "kind", "reason", "result.out as text", "reason is not null as copied", "content"
    )

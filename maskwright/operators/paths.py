"""File names: classification, pruning, exclusions, coverage, changes, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.text import Sql, q
from ..session import materialize


#: Lists of paths up to this length, and up to so many bytes with what belongs to the paths,
#: are sent to all executors.  The driver holds several times the bytes of each.
BROADCAST_PATHS = 500_000
BROADCAST_BYTES = 8 << 20
MAP_BITS = 1 << 26  # 8 MB


@dataclass(frozen=True)
class Limits:
    """What files of no known kind may be left unscanned for.  By default nothing is
    left out for its size, and a zero byte anywhere makes a file binary."""

    max_bytes: int | None = None
    sniff_bytes: int | None = None


#: The limits of a quick scan on one machine.
QUICK = Limits(fv.FALLBACK_MAX_BYTES, fv.BINARY_SNIFF_BYTES)


def _bit(path: Sql) -> Sql:
    return f"pmod(xxhash64({path}), {MAP_BITS}L)"


def _bitmap(listed: DataFrame) -> DataFrame:
    """One row with an array of words: a bit for the hash of every listed path.  Its size
    does not depend on the list."""
    words = listed.selectExpr(f"{_bit('path')} as b").groupBy(F.expr("b div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")
    )
    every = listed.sparkSession.range(MAP_BITS // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w")).select("w.bits")


def join_listed(files: DataFrame, listed: DataFrame, how: str, label: str) -> DataFrame:
    """Files joined on ``path`` (left_semi, inner, left_anti or left) with a list of paths and
    what belongs to them.  A short list is sent to the files.  Of a long one a bitmap of
    hashes is sent, and only files that may be listed are exchanged: all other files, with
    their texts, stay where they are."""
    stored = materialize(listed, label)
    # rows of a hash table have some bytes of their own beside the texts
    size = " + ".join(["32", *(f"coalesce(octet_length(cast(`{c}` as string)), 0)" for c in listed.columns)])
    n, held = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()
    if n <= BROADCAST_PATHS and held <= BROADCAST_BYTES:
        return files.join(F.broadcast(stored), "path", how)
    words = materialize(_bitmap(stored), "path-bitmap").scalar()
    word, place = F.expr(f"cast({_bit('path')} div 64 as int)"), F.expr(f"cast({_bit('path')} % 64 as int)")
    may = F.coalesce(F.get(words, word).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)) != 0, F.lit(False))
    near = files.where(may).join(stored.hint("merge"), "path", how)
    if how in ("left_semi", "inner"):
        return near
    both = near.unionByName(files.where(~may), allowMissingColumns=True)
    # A projection above a union goes into each of its branches: a scan's, of many thousand
    # expressions, would be planned and compiled for each.  It stays above a generator.
    return both.selectExpr(f"inline(array(struct({', '.join(f'`{c}`' for c in both.columns)})))")


def file_name(path: Sql) -> Sql:
    return tx.extract(path, r"[^/]*\z")


def extension(path: Sql) -> Sql:
    """Lower-case suffix without its dot; '' for none.  A leading dot alone
    (``.env``) or a trailing one is no suffix."""
    return f"lower({tx.extract(path, r'[^/]\.([^./]+)\z', 1)})"


def classify(path: Sql) -> Sql:
    """``config``, ``code:<language>``, or null."""
    is_env = f"({file_name(path)} = {q(fv.CONFIG_FILE_NAME)} or {file_name(path)} like '{fv.CONFIG_FILE_NAME}.%')"
    by_suffix = tx.let(
        extension(path),
        lambda e: f"if({tx.one_of(e, fv.CONFIG_EXTENSIONS)}, 'config',"
        f" concat('code:', {tx.lookup(fv.CODE_EXTENSIONS, e)}))",
    )
    return f"if({is_env}, 'config', {by_suffix})"


def below_skipped_dir(path: Sql) -> Sql:
    """Some directory of the path (not the file name) is always skipped."""
    names = ", ".join(q(d) for d in fv.SKIP_DIRS)
    return tx.let(
        f"split({path}, '/')", lambda p: f"arrays_overlap(slice({p}, 1, size({p}) - 1), array({names}))"
    )


def prune_skip_dirs(files: DataFrame) -> DataFrame:
    return files.where(f"not {below_skipped_dir('path')}")


def directories(path: Sql) -> Sql:
    """All directories above a path, outermost first, without the root."""
    return tx.let(
        f"split({path}, '/')",
        lambda p: f"if(size({p}) = 1, cast(array() as array<string>),"
        + tx.each(f"sequence(1, size({p}) - 1)", lambda n: f"array_join(slice({p}, 1, {n}), '/')") + ")",
    )


def exclude(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop files that are listed in ``excluded(path)`` or lie below a listed
    directory.  Prefix matching becomes an equality join on ancestors, on paths alone;
    the files then meet a list of paths."""
    ancestors = f"explode(concat({directories('path')}, array(path))) as ancestor"
    hit = (
        files.selectExpr("path", ancestors)
        .join(excluded.selectExpr("path as ancestor"), "ancestor", "left_semi")
        .select("path").distinct()
    )
    return join_listed(files, hit, "left_anti", "excluded-paths")


def folder_state(paths: DataFrame) -> DataFrame:
    """``paths(path, checked)`` to one row per directory (root is '') with the
    number of files and checked files below it, and its box state."""
    return (
        paths.selectExpr(f"explode(concat(array(''), {directories('path')})) as dir", "cast(checked as int) as checked")
        .groupBy("dir")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("checked").alias("n_checked"))
        .withColumn(
            "state",
            F.expr("case when n_checked = 0 then 'unchecked' when n_checked = n_files then 'checked' else 'indeterminate' end"),
        )
    )


def collapse_exclusions(paths: DataFrame) -> DataFrame:
    """Smallest list of files and directories that names every unchecked file.

    A node is listed if nothing at or below it is checked while its parent
    directory holds something checked.
    """
    empty_dirs = folder_state(paths).where("state = 'unchecked'").select("dir")
    nodes = empty_dirs.selectExpr("dir as path").unionByName(paths.where("not checked").select("path"))
    parent = tx.sub("path", r"/?[^/]*\z", "")
    inner = (
        nodes.where("path <> ''").withColumn("dir", F.expr(parent))
        .join(empty_dirs, "dir", "left_anti").select("path")
    )
    return nodes.where("path = ''").unionByName(inner)


def list_files(files: DataFrame) -> DataFrame:
    """Relative paths in order, without skipped directories and without reading
    any content."""
    return prune_skip_dirs(files.select("path")).orderBy("path")


def only_changed(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files whose content hash is new or differs from ``manifest(path, hash)``.

    No manifest means the baseline is unknown, which is an error; a manifest
    that equals the files gives an empty result.  The output is partial.  Hashes meet
    the manifest without the contents.
    """
    if manifest is None:
        raise ValueError("no baseline manifest: a full scan is required")
    old = manifest.selectExpr("path", "hash as old_hash")
    changed = files.select("path", "hash").join(old, "path", "left").where("not (hash <=> old_hash)").select("path")
    return join_listed(files, changed.distinct(), "left_semi", "changed-paths").withColumn("partial", F.lit(True))


def is_oversize(length: Sql, max_bytes: int = fv.FALLBACK_MAX_BYTES) -> Sql:
    return f"({length} > {max_bytes})"


def is_binary(path: Sql, content: Sql, sniff_bytes: int | None = None) -> Sql:
    """Known binary suffix, or a zero byte in the content (or in its first bytes)."""
    head = content if sniff_bytes is None else f"substring({content}, 1, {sniff_bytes})"
    return f"({tx.one_of(extension(path), fv.BINARY_EXTENSIONS)} or position(X'00', {head}) > 0)"


def unscanned_reason(path: Sql, length: Sql, content: Sql, limits: Limits = Limits(), kind: Sql = "null") -> Sql:
    """Why a file is not scanned: it is too large to load at all, or of no known kind
    and too large (if there is a limit) or binary."""
    too_large = f"{content} is null and {length} > 0"
    size = f"when {is_oversize(length, limits.max_bytes)} then 'oversize'" if limits.max_bytes is not None else ""
    return (
        f"case when {too_large} then 'not_loaded' when {kind} is not null then null {size}"
        f" when {is_binary(path, content, limits.sniff_bytes)} then 'binary' end"
    )


STATUS = "case when reason is not null then 'unscanned' when kind is null then 'fallback' else 'scanned' end as status"


def coverage(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``files(path, length, content)`` to (path, kind, status, reason)."""
    return (
        files.withColumn("kind", F.expr(classify("path")))
        .withColumn("reason", F.expr(unscanned_reason("path", "length", "content", limits, "kind")))
        .selectExpr("path", "kind", "reason", STATUS)
    )


def walk_key(path: Sql) -> Sql:
    """Sorts like a directory walk: files of a directory come before its
    subdirectories, each by name.  One string, so range partitioning and
    comparison stay cheap."""
    dirs = tx.sub(tx.sub(path, r"[^/]*\z", ""), r"([^/]+)/", "1$1\x01")
    return f"concat({dirs}, '0', {file_name(path)})"

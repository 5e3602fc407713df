"""From an input tree to a sanitized output folder in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import paths
from ..operators.history import scan_summary
from ..operators.hits import Context
from ..operators.ignores import attach
from ..session import kept, materialize, scratch
from .. import fixed_values as fv
from ..sources.corpus import decode_text, with_hash
from ..sources.listing import list_tree
from ..sources.parts import read_files
from ..sources.sinks import write_sanitized, write_tree
from .staging import Sanitized, sanitized, scan_once


@dataclass
class ProjectScan:
    """What a scan leaves: the written files, findings without values, coverage and a
    summary; with a target tree, also the list of its files."""

    sanitized: Sanitized
    coverage: DataFrame
    summary: DataFrame
    written: DataFrame | None = None


def select_files(listed: DataFrame, input_root: str, excluded: DataFrame | None, manifest: DataFrame | None, changed_only: bool) -> DataFrame:
    """Files of a listing to scan: not below a skipped directory, not excluded, and (if
    asked) changed since the manifest.  Only paths take part, and hashes where asked."""
    chosen = paths.prune_skip_dirs(listed)
    if excluded is not None:
        chosen = paths.exclude(chosen, excluded)
    if changed_only:
        tasks = 4 * chosen.sparkSession.sparkContext.defaultParallelism
        hashed = materialize(with_hash(chosen.repartition(tasks, "path"), input_root), "hashes")
        chosen = paths.only_changed(hashed, manifest).drop("hash", "partial")
    return chosen


def scan_project(
    spark: SparkSession, input_root: str, output: str, ctx: Context, *, ignores: DataFrame | None = None,
    excluded: DataFrame | None = None, manifest: DataFrame | None = None, changed_only: bool = False, tree: str | None = None,
    part_bytes: int = 0, results: str | None = None,
) -> ProjectScan:
    """Scan a tree and write its sanitized copy, as a table and (to ``tree``) as files.

    Every file is read and scanned once, one larger than ``part_bytes`` (default
    ``parts.PART_BYTES``) in parts.  Findings, coverage, the list of written files and the
    tokens are stored below ``results`` (default: the shared folder).  With ``changed_only`` the output holds only the
    files that changed, so it is partial and no full copy of the tree.
    """
    with scratch(spark):
        listed = select_files(list_tree(spark, input_root, fv.SKIP_DIRS), input_root, excluded, manifest, changed_only)
        if ignores is not None:  # meets paths, before any content is read
            listed = attach(listed, ignores)
        files = decode_text(read_files(listed, input_root, ctx.limits, part_bytes))
        scanned = scan_once(files, ctx)
        done = sanitized(scanned, ctx.tokens)
        write_sanitized(done.files, output, input_root)
        written = kept(write_tree(done.files, tree, input_root), "written", results) if tree else None
        found = kept(done.findings.drop("value", "after", "uses"), "findings", results)
        covered = kept(scanned.where("part = 0").selectExpr("path", "kind", "reason", paths.STATUS), "coverage", results)
        numbers = kept(done.tokens, "tokens", results) if done.tokens is not None else None
    return ProjectScan(
        Sanitized(spark.read.parquet(output), found, numbers), covered, scan_summary(found, covered, partial=changed_only), written
    )

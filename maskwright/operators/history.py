"""Scan history and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def safe_findings(findings: DataFrame) -> DataFrame:
    """Findings without any value, with a flag that is never null."""
    return findings.selectExpr("file", "line", "key", "rule", "coalesce(changed, false) as changed")


def scan_summary(findings: DataFrame, coverage: DataFrame, partial: bool = False) -> DataFrame:
    """One row: files scanned and not scanned, redactions, partial flag."""
    counted = coverage.selectExpr(
        "if(status = 'unscanned', 0L, 1L) as files_scanned", "if(status = 'unscanned', 1L, 0L) as files_unscanned",
        "0L as total_redactions",
    ).unionAll(findings.selectExpr("0L", "0L", "1L"))
    return counted.groupBy().sum().toDF("files_scanned", "files_unscanned", "total_redactions").withColumn(
        "partial", F.lit(partial)
    )


def list_scans(scans: DataFrame) -> DataFrame:
    """Scans of each project, newest first."""
    return scans.orderBy("project_id", F.desc("ts"), F.desc("scan_id"))


def latest_scans(scans: DataFrame) -> DataFrame:
    """Newest scan per project.  An aggregate with map-side combine, so a project
    with very many scans is no hot spot."""
    others = [c for c in scans.columns if c != "project_id"]
    newest = F.max_by(F.struct(*others), F.struct("ts", "scan_id"))
    return scans.groupBy("project_id").agg(newest.alias("s")).select("project_id", "s.*")


def retain_recent(scans: DataFrame, k: int = fv.RETAINED_SCANS) -> DataFrame:
    """The k most recent scans over all projects (a top-k, never a full sort)."""
    return scans.orderBy(F.desc("ts"), F.desc("scan_id")).limit(k)


def drop_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """All tables without the rows of one project."""
    return {name: t.where(F.col("project_id") != project_id) for name, t in tables.items()}


def unscanned_by_reason(coverage: DataFrame) -> DataFrame:
    """(reason, path, n_files): the unscanned files next to the size of their
    group.  Paths stay rows, since one reason can hold most of a corpus."""
    unscanned = coverage.where("status = 'unscanned'").select("reason", "path")
    sizes = unscanned.groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))
    # one row per reason, of which there are two
    return unscanned.join(F.broadcast(sizes), "reason")


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Number of findings by category and rule with totals, and by file."""
    by_rule = findings.rollup("category", "rule").agg(F.count(F.lit(1)).alias("n"))
    by_file = findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return by_rule.selectExpr("cast(null as string) as file", "category", "rule", "n").unionByName(
        by_file.selectExpr("file", "'(any)' as category", "'(any)' as rule", "n")
    )

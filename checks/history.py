"""Checks of the ignore list, staging and scan history."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright import fixed_values as fv
from maskwright.functions import text as tx
from maskwright.operators import history, paths
from maskwright.operators import ignores as ign
from maskwright.operators.hits import findings
from maskwright.operators.shapes import detect_shapes
from maskwright.plans import staging
from maskwright.plans.publish import History
from maskwright.plans.scan import scan, scan_findings
from maskwright.session import materialize, new_folder

from . import carriers, duck
from .detection import BINARY, MASKED, TREE_FOUND, TREE_OUT, VARIED, varied, with_bytes
from .registry import carrier, query, table, text_lines, tree_files
from .sources import cfg_found as all_cfg_found


def cfg_found(spark, folder):
    return all_cfg_found(spark, folder).withColumn("file", F.expr("concat(file, ':', line)"))



# ---- ignore list -----------------------------------------------------------

# every line in a file of its own name, so that ignores hit single values
CFG_FOUND = f"(select path || ':' || cast(line_no as varchar) as file, line_no as line, key, rule, value from ({duck.config_all(duck.CFG)}))"
IGNORES = (
    "(select file, key, rule, max(case line % 3 when 0 then sha256(value) when 1 then sha256('old') end) as value_hash"
    f" from {CFG_FOUND} where line % 5 = 0 group by file, key, rule)"
)


def some_ignores(found):
    state = "case line % 3 when 0 then sha2(value, 256) when 1 then sha2('old', 256) end"
    return found.where("line % 5 = 0").groupBy("file", "key", "rule").agg(F.max(F.expr(state)).alias("value_hash"))


@query("value_hashes", f"select file, line, sha256(value) as value_hash from {CFG_FOUND}")
def value_hashes(spark, folder):
    return cfg_found(spark, folder).selectExpr("file", "line", f"{tx.value_hash('value')} as value_hash")


KEPT = (
    f"(select f.file, f.line, f.key, f.rule, i.file is not null as changed from {CFG_FOUND} f left join {IGNORES} i"
    " on i.file = f.file and i.key is not distinct from f.key and i.rule = f.rule where i.file is null or i.value_hash is null or i.value_hash <> sha256(f.value))"
)


@query("apply_ignores", f"select * from {KEPT}")
def apply_ignores(spark, folder):
    """With entries that stand in the list twice."""
    found = cfg_found(spark, folder)
    listed = some_ignores(found)
    twice = listed.selectExpr("file", "key", "rule", "explode(array(value_hash, cast(null as string), value_hash)) as value_hash")
    return ign.apply_ignores(found, twice).select("file", "line", "key", "rule", "changed")


@query("newly_unredacted", f"select distinct file, key, rule from {CFG_FOUND} except select distinct file, key, rule from {KEPT}")
def newly_unredacted(spark, folder):
    found = cfg_found(spark, folder)
    return ign.newly_unredacted(found, ign.apply_ignores(found, some_ignores(found)))


@query(
    "unredacted_by_ignores",
    f"select distinct path as file, key, rule from ({TREE_FOUND}) where strlen(path) % 3 = 0 and not starts_with(rule, 'multiline_concat_')",
)
def unredacted_by_ignores(spark, folder):
    """All kinds of files scanned with and without ignores inside the scan.  The hash of
    a fragment is not that of the concatenation it is part of, so those stay redacted."""
    files = tree_files(spark, folder)
    found = scan_findings(files, MASKED).withColumnRenamed("path", "file").where("octet_length(file) % 3 < 2")
    state = "if(octet_length(file) % 3 = 0, sha2(value, 256), sha2('old', 256)) as value_hash"
    ignores = materialize(found.selectExpr("file", "key", "rule", state).dropDuplicates(["file", "key", "rule"]), "ignores")
    return staging.unredacted_by_ignores(files, ignores, MASKED)


EVENT_IGNORES = """select concat('f', cast(user_id as string)) as file, case when user_id % 3 = 0 then cast(null as string) else event_type end as key,
 event_type as rule, md5(props) as value_hash, ts as created_at, event_id as id from {events}"""
DUCK_EVENT_IGNORES = "(" + EVENT_IGNORES.format(events="events") + ")"


def event_ignores(spark, folder):
    return spark.sql(EVENT_IGNORES.format(events="{events}"), events=table(spark, folder, "events"))


@query(
    "upsert_ignore",
    "select file, key, rule, value_hash, created_at from (select *, row_number() over (partition by file, key, rule order by created_at desc, value_hash desc) as i"
    f" from {DUCK_EVENT_IGNORES}) where i = 1",
)
def upsert_ignore(spark, folder):
    rows = event_ignores(spark, folder)
    return ign.upsert_ignore(rows.where("id % 3 <> 0").drop("id"), rows.where("id % 3 = 0").drop("id"))


@query("remove_ignore", f"select * from {DUCK_EVENT_IGNORES} where id % 4 <> 0")
def remove_ignore(spark, folder):
    rows = event_ignores(spark, folder)
    return ign.remove_ignore(rows, rows.where("id % 4 = 0").select("id"))


RAW = """select concat('f', cast(user_id % 40 as string)) as file, case when user_id % 3 = 0 then cast(null as string) else 'k' end as key, event_type as rule,
 concat(props, cast(floor(value) as int)) as value, event_id as pos, event_id % 5 as scan_id from {events}"""
DUCK_RAW = "(" + RAW.format(events="events") + ")"


@query(
    "lookup_hash",
    "with w as (select distinct file, key, rule from " + DUCK_RAW + "),"
    f" c as (select *, case when pos % 50 = 0 then 0 when scan_id = 4 then 1 end as rank from {DUCK_RAW}),"
    " b as (select * from (select *, row_number() over (partition by file, key, rule order by rank, pos) as i from c where rank is not null) where i = 1)"
    " select w.file, w.key, w.rule, sha256(b.value) as value_hash from w left join b on b.file = w.file and b.key is not distinct from w.key and b.rule = w.rule",
)
def lookup_hash(spark, folder):
    rows = spark.sql(RAW.format(events="{events}"), events=table(spark, folder, "events"))
    latest = rows.agg(F.max("scan_id").alias("scan_id"))
    return ign.lookup_hash(rows.select("file", "key", "rule").distinct(), rows.where("pos % 50 = 0"), rows, latest)


_ROW = "concat_ws(chr(2), '0', file, coalesce(key, chr(3)), rule, coalesce(value_hash, chr(3)))"


def _fingerprint(rows: str) -> str:
    return (
        f"select count(*) as n_rows, cast(sum(cast('0x' || substr(h, 1, 15) as bigint)) as varchar) as sum_hash,"
        f" bit_xor(cast('0x' || substr(h, 16, 15) as bigint)) as xor_hash from (select md5({_ROW}) as h from {rows})"
    )


@query(
    "state_fingerprint",
    f"select 'before' as state, * from ({_fingerprint(IGNORES)}) union all select 'after' as state, * from ({_fingerprint(f'(select * from {IGNORES} where rule <> {chr(39)}high_entropy{chr(39)})')})",
)
def state_fingerprint(spark, folder):
    ignores = some_ignores(cfg_found(spark, folder))
    before, after = ign.state_fingerprint(ignores), ign.state_fingerprint(ignores.where("rule <> 'high_entropy'"))
    return before.select(F.lit("before").alias("state"), "*").unionByName(after.select(F.lit("after").alias("state"), "*"))


@query("stale_preview", f"select count(*) > 0 as changed, false as same from {IGNORES} where rule = 'high_entropy'")
def stale_preview(spark, folder):
    ignores = some_ignores(cfg_found(spark, folder))
    state = ign.state_fingerprint(ignores)
    other = ign.state_fingerprint(ignores.where("rule <> 'high_entropy'"))
    both = ign.is_stale(state, other).selectExpr("stale as changed", "null as same").unionByName(
        ign.is_stale(state, ign.state_fingerprint(ignores)).selectExpr("null as changed", "stale as same")
    )
    return both.selectExpr("max(changed) as changed", "max(same) as same")


_LEFT_READABLE = f"(select distinct path from ({TREE_FOUND}) where path like '%.properties' and strlen(path) % 2 = 0)"


@query(
    "stage_and_apply",
    f"select o.path, case when r.path is null then o.text else f.text end as text from ({TREE_OUT}) o left join {_LEFT_READABLE} r on r.path = o.path"
    f" left join {duck.FILES} f on f.path = o.path where strlen(o.path) % 7 <> 0 and not starts_with(o.path, 'tree2/')",
)
def stage_and_apply(spark, folder):
    """Preview, promote, read the target: a direct scan of the files that are not
    excluded, singly or by folder.  Some ignored values are left readable, as the preview
    said; ignores for values that are no longer there leave nothing."""
    files = tree_files(spark, folder)
    found = scan_findings(files, MASKED).where("path like '%.properties'")
    ignores = materialize(found.selectExpr("path as file", "key", "rule", "if(octet_length(path) % 2 = 0, sha2(value, 256), sha2('old', 256)) as value_hash"), "ignores")
    names = files.select("path")
    excluded = names.where("octet_length(path) % 7 = 0").union(spark.sql("select 'tree2' as path"))
    staged = staging.stage(spark, files, ignores, excluded, MASKED)
    shown = staged.newly_unredacted.select("file").distinct().count()
    out = new_folder(spark, "applied")
    staging.apply_stage(spark, staged, staging.state_of(ignores, excluded, MASKED), out)
    applied = spark.read.parquet(out)
    really = applied.join(files.select("path", F.col("text").alias("was")), "path").join(ignores.selectExpr("file as path").distinct().hint("merge"), "path").where("text = was").count()
    if shown != really:
        raise AssertionError(f"the preview showed {shown} files with readable values, there are {really}")
    return applied.select("path", "text")


# ---- history ---------------------------------------------------------------


@query(
    "scan_summary",
    f"select (select count(*) from {duck.FILES}) + (select count(*) from {duck.BLOCKS}) as files_scanned, 0 as files_unscanned,"
    f" (select count(*) from ({TREE_FOUND})) as total_redactions, true as partial",
)
def scan_summary(spark, folder):
    files = tree_files(spark, folder)
    return history.scan_summary(findings(scan(files, MASKED), "path"), paths.coverage(files), partial=True)


@query("scan_list", f"select * from {duck.SCANS} order by project_id, ts desc, scan_id desc")
def scan_list(spark, folder):
    return history.list_scans(carrier(spark, folder, carriers.SCANS))


@query(
    "latest_scans",
    f"select project_id, scan_id, ts, total_redactions from (select *, row_number() over (partition by project_id order by ts desc, scan_id desc) as i from {duck.SCANS}) where i = 1",
)
def latest_scans(spark, folder):
    return history.latest_scans(carrier(spark, folder, carriers.SCANS))


@query("retain_recent_scans", f"select * from {duck.SCANS} order by ts desc, scan_id desc limit {fv.RETAINED_SCANS}")
def retain_recent_scans(spark, folder):
    return history.retain_recent(carrier(spark, folder, carriers.SCANS))


@query(
    "drop_project",
    f"select 'scans' as name, project_id, count(*) as n from {duck.SCANS} where project_id <> 3 group by all"
    f" union all select 'ignores', project_id, count(*) from (select project_id from {duck.SCANS} where scan_id % 2 = 0) where project_id <> 3 group by all",
)
def drop_project(spark, folder):
    scans = carrier(spark, folder, carriers.SCANS)
    left = history.drop_project({"scans": scans, "ignores": scans.where("scan_id % 2 = 0")}, 3)
    parts = [t.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(n)) for n, t in left.items()]
    return parts[0].unionByName(parts[1])


_COVERED = (
    f"(select path, case when length * 100 > 2097152 then 'oversize' when {BINARY} then 'binary' end as reason"
    f" from (select *, {duck.kind('path')} as kind from {VARIED}) where kind is null)"
)


@query(
    "unscanned_by_reason",
    f"select reason, path, count(*) over (partition by reason) as n_files from {_COVERED} where reason is not null",
)
def unscanned_by_reason(spark, folder):
    covered = paths.coverage(with_bytes(varied(spark, folder)).withColumn("length", F.expr("length * 100")), paths.QUICK)
    return history.unscanned_by_reason(covered)


_SHAPE_FOUND = f"({duck.shape_findings(duck.TEXT_LINES)})"


@query(
    "findings_rollup",
    f"select cast(null as varchar) as file, category, rule, count(*) as n from {_SHAPE_FOUND} group by rollup (category, rule)"
    f" union all select path as file, '(any)', '(any)', count(*) from {_SHAPE_FOUND} group by path",
)
def findings_rollup(spark, folder):
    found = findings(detect_shapes(text_lines(spark, folder), MASKED), "path")
    return history.findings_rollup(found.withColumnRenamed("path", "file"))


_STORED = (
    "(select user_id % 50 as project_id, event_id as id, 'f' || cast(user_id as varchar) as file, case when user_id % 3 = 0 then cast(null as varchar) else event_type end as key,"
    " event_type as rule, md5(props) as value_hash, ts as created_at from events)"
)


@query(
    "stored_history",
    f"""select 'ignores' as name, project_id, cast(count(*) as bigint) as n, cast(sum(id) as bigint) as ids from (
  select *, row_number() over (partition by project_id, file, key, rule order by created_at desc, value_hash desc, id desc) as i from {_STORED})
  where i = 1 and id % 5 <> 0 and project_id <> 3 group by project_id
 union all select 'scans', project_id, count(*), sum(scan_id) from {duck.SCANS} where project_id <> 3 group by project_id
 union all select 'findings', project_id, count(*), sum(scan_id) from (select * from {duck.SCANS} order by ts desc, scan_id desc limit {fv.RETAINED_SCANS})
  where project_id <> 3 group by project_id""",
)
def stored_history(spark, folder):
    """Inserts, replacements, removals, retention and the deletion of a project, each a
    change of a stored table that is read back; a change that fails leaves nothing."""
    past = History(spark, new_folder(spark, "history"))
    scans = carrier(spark, folder, carriers.SCANS)
    events = table(spark, folder, "events")
    rows = spark.sql(
        "select user_id % 50 as project_id, event_id as id, concat('f', user_id) as file, if(user_id % 3 = 0, null, event_type) as key,"
        " event_type as rule, md5(props) as value_hash, ts as created_at from {events}", events=events,
    )
    with past.store.change() as change:
        past.append(change, "scans", scans)
        past.append(change, "findings", scans.selectExpr("project_id", "scan_id", "'f' as file", "1 as line", "'k' as key", "'r' as rule", "false as changed"))
    past.upsert_ignores(rows.where("id % 3 <> 0"))
    past.upsert_ignores(rows.where("id % 3 = 0"))
    past.remove_ignores(rows.where("id % 5 = 0").select("project_id", "id"))
    past.retain()
    try:
        past.upsert_ignores(rows.withColumn("value_hash", F.expr("raise_error('a writer fails')")))
        raise AssertionError("the failing writer did not fail")
    except Exception as error:
        if "a writer fails" not in str(error):
            raise
    past.drop_project(3)
    counts = [
        past.read(t).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("ids")).selectExpr(f"'{t}' as name", "project_id", "n", "ids")
        for t, c in (("ignores", "id"), ("scans", "scan_id"), ("findings", "scan_id"))
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])

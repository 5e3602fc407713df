"""Stored tables that change at once: runs, history, batches of a stream."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskwright.operators.hits import mask_context, token_context
from maskwright.operators.ignores import state_fingerprint
from maskwright.plans import project
from maskwright.plans.publish import WRITTEN, History, publish_project
from maskwright.sources.corpus import from_table
from maskwright.sources.store import Conflict, Store
from maskwright.streaming.published import FOUND, STATES, drain_published, publish_batch


def data(spark, *rows):
    return spark.createDataFrame(list(rows), "a int")


def put(change, df, name="t"):
    folder = change.folder()
    df.write.parquet(folder)
    change.put(name, folder)


def test_changes_are_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    read = lambda **v: [r.a for r in store.read("t", "a int", **v).collect()]
    assert store.versions() == [] and read() == []
    with store.change() as change:
        put(change, data(spark, (1,)))
        put(change, data(spark, (5,)), "other")
    assert store.versions() == [1] and read() == [1]
    folders = {p.name for p in (tmp_path / "s").iterdir()}
    with pytest.raises(ZeroDivisionError), store.change() as change:
        put(change, data(spark, (2,)))
        raise ZeroDivisionError
    assert store.versions() == [1] and read() == [1] and {p.name for p in (tmp_path / "s").iterdir()} == folders
    with pytest.raises(Conflict), store.change() as late:
        put(late, data(spark, (3,)))
        with store.change() as change:
            put(change, data(spark, (4,)))
    assert store.versions() == [1, 2] and read() == [4] and read(version=1) == [1]
    store.vacuum()
    assert store.versions() == [2] and read() == [4] and [r.a for r in store.read("other", "a int").collect()] == [5]
    assert len(list((tmp_path / "s").iterdir())) == 3  # two data folders and the log


@pytest.fixture
def tree(tmp_path):
    for i in range(12):
        target = tmp_path / "in" / f"d{i % 3}" / f"{i}.ini"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"password=secret{i}\n")
    return tmp_path


def test_a_run_is_published_whole(spark, tree, monkeypatch):
    target = str(tree / "out")
    store = publish_project(spark, str(tree / "in"), target, token_context())
    written = lambda: {(r.path, r.sha256) for r in store.read("written", WRITTEN).collect()}
    files = lambda: {str(p.relative_to(tree / "out" / store.tables()["tree"][0])) for p in (tree / "out" / store.tables()["tree"][0]).rglob("*.ini")}
    first, there = written(), {p for p in Path(target).rglob("*") if p.is_file()}
    assert len(first) == 12 and files() == {p for p, _ in first} and set(store.tables()) == {"files", "tree", "findings", "coverage", "written", "tokens"}

    # a task that fails for good: one file cannot be written
    (tree / "in" / "d0" / "new.ini").write_text("password=x\n")
    real = project.write_tree

    def failing(staged, output, root):
        out = real(staged.where("path not like '%new%'"), output, root)  # files of this run are there already
        return out.selectExpr("raise_error('a task fails') as path", "length", "sha256", "copied")

    monkeypatch.setattr(project, "write_tree", failing)
    with pytest.raises(Exception, match="a task fails"):
        publish_project(spark, str(tree / "in"), target, mask_context())
    assert written() == first and {p for p in Path(target).rglob("*") if p.is_file()} == there
    monkeypatch.undo()
    publish_project(spark, str(tree / "in"), target, mask_context(), keep=1)
    assert len(written()) == 13 == len(files()) and store.versions() == [2] and "tokens" not in store.tables()
    assert not any(p in there for p in Path(target).rglob("*.ini"))  # the first run is gone


def test_history_is_stored_and_changed(spark, tmp_path):
    past = History(spark, str(tmp_path / "h"), buckets=4)
    found = spark.createDataFrame([("f", 1, "k", "r", True, "value"), ("f", 2, None, "r", None, "value")], "file string, line int, key string, rule string, changed boolean, value string")
    for scan in range(6):
        past.record_scan(scan % 3, scan, f"2026-01-0{scan + 1} 00:00:00", found)
    assert past.read("findings").columns == ["project_id", "scan_id", "file", "line", "key", "rule", "changed"]  # no value
    assert past.read("scans").count() == 6 and past.read("findings").count() == 12
    past.retain(2)
    assert {r.scan_id for r in past.read("findings").collect()} == {4, 5} and past.read("scans").count() == 6
    rows = [(p, 10 * p + i, "f", None if i else "k", "r", f"h{i}", f"2026-01-0{1 + i} 00:00:00") for p in range(3) for i in range(2)]
    kind = "project_id bigint, id bigint, file string, key string, rule string, value_hash string, created_at string"
    table = lambda rows: spark.createDataFrame(rows, kind).withColumn("created_at", F.to_timestamp("created_at"))
    past.upsert_ignores(table(rows))
    before = past.store.tables()
    past.upsert_ignores(table([(1, 99, "f", "k", "r", "new", "2026-02-01 00:00:00")]))
    after = past.store.tables()
    assert sum(before[n] != after.get(n) for n in before) == 1  # one bucket was written anew
    got = {(r.project_id, r.id, r.key, r.value_hash) for r in past.read("ignores").collect()}
    assert got == {(p, 10 * p + i, None if i else "k", f"h{i}") for p in range(3) for i in range(2)} - {(1, 10, "k", "h0")} | {(1, 99, "k", "new")}
    past.remove_ignores(spark.createDataFrame([(0, 0), (2, 77)], "project_id bigint, id bigint"))
    assert past.read("ignores").count() == 5
    version = past.store.versions()[-1]
    with pytest.raises(Exception), past.store.change() as change:  # a writer fails half way
        past.rewrite(change, "ignores", None, lambda old: old.where("project_id = 0"))
        past.rewrite(change, "scans", None, lambda old: old.selectExpr("raise_error('x') as project_id", "scan_id", "ts", "total_redactions"))
    assert past.store.versions()[-1] == version and past.read("ignores").count() == 5
    past.drop_project(1)
    assert {t: {r.project_id for r in past.read(t).collect()} for t in past.TABLES} == {"scans": {0, 2}, "findings": {2}, "ignores": {0, 2}}


def test_batches_with_lists_that_change(spark, tmp_path):
    """Three batches under two lists; a batch that comes again changes nothing."""
    docs = tmp_path / "docs"
    schema = "path string, text string"
    for i in range(3):
        spark.createDataFrame([(f"b{i}.ini", "password=one")], schema).coalesce(1).write.mode("append").parquet(str(docs))
    lists = [[("b0.ini", "one"), ("b1.ini", "other")], [("b2.ini", "one")]]
    table = lambda rows: spark.createDataFrame(rows, "file string, value string").selectExpr("file", "'password' as key", "'key_name_match' as rule", "sha2(value, 256) as value_hash")
    calls = []

    def ignores():
        calls.append(1)
        return table(lists[0] if len(calls) < 3 else lists[1])

    store, ctx = Store(spark, str(tmp_path / "s")), mask_context()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(docs))
    drain_published(from_table(stream, "path", "text"), store, ctx, ignores, str(tmp_path / "c"))
    assert len(calls) == 3 and store.versions() == [1, 2, 3]
    by_batch = {r.batch: r for r in store.read("findings", FOUND).collect()}
    order = [r.path for _, r in sorted(by_batch.items())]
    states = {r.batch: r.sum_hash for r in store.read("states", STATES).collect()}
    want = [state_fingerprint(table(x)).first().sum_hash for x in (lists[0], lists[0], lists[1])]
    assert [states[b] for b in range(3)] == want
    paths = {r.path for r in by_batch.values()}
    assert "b1.ini" in paths and all(r.changed == (r.path == "b1.ini" and r.batch < 2) for r in by_batch.values()), order
    again = from_table(spark.createDataFrame([("x.ini", "password=two")], schema), "path", "text")
    publish_batch(store, ctx, ignores)(again, 1)
    assert store.versions() == [1, 2, 3] and {r.path for r in store.read("findings", FOUND).collect()} == paths and len(calls) == 3

"""How the checks read their tables and share out the work."""

import re

import pytest

import __spark_entry__ as entry
from checks import carriers, registry, streams
from checks.detection import MASKED
from maskwright.operators import ignores as ign
from maskwright.operators import paths
from maskwright.plans.scan import scan, scan_findings
from maskwright.session import new_folder
from maskwright.sources.corpus import from_table


@pytest.fixture(scope="module")
def folder(spark):
    """Documents in several files."""
    at = new_folder(spark, "tables")
    text = "concat('mail u', id, '@mail.example.org\n', 'key AK', 'IA', upper(substr(md5(cast(id as string)), 1, 16)), ' end')"
    docs = spark.range(1, 41).selectExpr("id as doc_id", f"{text} as text", "if(id % 2 = 0, 'en', 'de') as lang", "if(id % 3 = 0, 'web', 'wiki') as source")
    docs.repartition(4).write.parquet(f"{at}/documents.parquet")
    return at


def documents(spark, folder):
    return scan_findings(from_table(registry.table(spark, folder, "documents"), streams._PATH, "text"), MASKED)


@pytest.mark.parametrize("name", ["stream_scan", "stream_scan_ignoring"])
def test_streams_of_a_table_in_many_files(spark, folder, name):
    found = documents(spark, folder)
    found = found.where("octet_length(path) % 2 = 1") if name == "stream_scan_ignoring" else found
    expected = sorted((r.path, r.line, r.rule) for r in found.collect())
    got = sorted((r.path, r.line, r.rule) for r in entry.queries()[name](spark, folder).collect())
    assert expected and got == expected


def test_a_batch_is_written_by_many_tasks(spark, folder, monkeypatch):
    made = {}
    monkeypatch.setattr(streams, "new_folder", lambda spark, label: made.setdefault(label, new_folder(spark, label)))
    spark.conf.set("spark.sql.files.openCostInBytes", str(32 << 20))  # a task for each of the small files
    try:
        got = entry.queries()["stream_published"](spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(spark.read.parquet(made["arriving"]).inputFiles()) > 3
    found = documents(spark, folder).collect()
    number = lambda r: int(re.search(r"doc_(\d+)", r.path)[1])
    expected = sorted((r.path, r.line, r.rule, number(r) % 3) for r in found if len(r.path) % 2 or number(r) % 3 == 2)
    assert sorted((r.path, r.line, r.rule, r.batch) for r in got) == expected


def test_derived_rows_are_dealt_by_number(spark, monkeypatch):
    at = new_folder(spark, "tables")
    spark.range(1, 41).selectExpr("id as c_custkey", "id % 5 as c_nationkey").coalesce(1).write.parquet(f"{at}/customer.parquet")
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 1000)
    whole = registry.cfg_lines(spark, at)
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 10)
    dealt = registry.cfg_lines(spark, at)
    assert carriers.tables(carriers.CFG_LINES) == ["customer"]
    assert (whole.rdd.getNumPartitions(), dealt.rdd.getNumPartitions()) == (1, 4)
    assert sorted(whole.collect()) == sorted(dealt.collect())
    for name in ("mask_config_span", "escape_xml_tokens"):
        plan = entry.queries()[name](spark, at)._jdf.queryExecution().optimizedPlan().toString()
        assert not any("aggregate(" in line for line in plan.splitlines() if "Filter" in line)


def test_long_lists_of_paths_are_not_sent_by_their_bytes_alone(spark, monkeypatch):
    texts = spark.range(200).selectExpr("concat('d/f', id, '.ini') as path", "concat('password=pw', id, 'x\\n') as text")
    corpus = registry.as_files(texts)
    ignores = scan_findings(corpus, MASKED).where("line = 1").selectExpr("path as file", "key", "rule", "sha2(value, 256) as value_hash").where("octet_length(file) = 9")

    def attached():
        df = ign.attach(corpus, ignores)
        plan = scan(df, MASKED)._jdf.queryExecution().optimizedPlan().toString()
        return sorted((r.path, str(r.ignores), r.text) for r in df.collect()), plan

    short, sent = attached()
    monkeypatch.setattr(paths, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(paths, "MAP_BITS", 1 << 14)
    long, kept = attached()
    assert long == short and sum(r[1] != "None" for r in long) == 90
    assert "strategy=broadcast" in sent and "strategy=broadcast" not in kept
    assert len(kept) < 1.5 * len(sent)  # the detectors stand in the plan once, not once a branch


def test_given_rows_are_dealt_before_anything_is_derived(spark, monkeypatch):
    at = new_folder(spark, "tables")
    spark.range(1, 61).selectExpr("id as c_custkey", "id % 5 as c_nationkey").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.range(1, 61).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size", "'Brand' as p_brand").coalesce(1).write.parquet(f"{at}/part.parquet")
    spark.range(1, 61).selectExpr("id as o_orderkey", "id % 7 as o_custkey").coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.range(1, 61).selectExpr("id as s_suppkey", "'S' as s_name").coalesce(1).write.parquet(f"{at}/supplier.parquet")
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 10)
    files = registry.tree_files(spark, at)
    plan = files._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [line for line in plan if "Repartition" in line]
    assert len(dealt) == 4
    assert not any("md5(" in line for i, line in enumerate(plan) for above in plan[:i] if "Repartition" in above and plan.index(above) == i - 1)
    scanned = scan(files, MASKED)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("as early" in line.lower() for line in scanned.splitlines()) == 1  # planned once, not for each table
    assert files.count() == 240 and files.rdd.getNumPartitions() == 24


def test_files_are_scanned_with_and_without_ignores_in_one_pass(spark, monkeypatch):
    from maskwright.plans import staging

    corpus = registry.as_files(spark.range(9).selectExpr("concat('f', id % 5, '.ini') as path", "concat('password=pw', id, 'x\n') as text"))
    ignores = spark.sql("select 'f' || id || '.ini' as file, 'password' as key, 'key_name_match' as rule, if(id < 3, sha2('pw' || id || 'x', 256), 'old') as value_hash from range(4)")
    made = []
    monkeypatch.setattr(staging, "materialize", lambda df, label, real=staging.materialize: made.append(label) or real(df, label))
    got = sorted(r.file for r in staging.unredacted_by_ignores(corpus, ignores, MASKED).collect())
    # f0 to f2 hold an ignored value, but f0 to f3 come twice, and the other text is found either way
    assert got == [] and made == ["places"]
    once = corpus.where("text in ('password=pw0x\n', 'password=pw1x\n', 'password=pw3x\n', 'password=pw4x\n')")
    assert sorted(tuple(r) for r in staging.unredacted_by_ignores(once, ignores, MASKED).collect()) == [
        ("f0.ini", "password", "key_name_match"), ("f1.ini", "password", "key_name_match"),
    ]

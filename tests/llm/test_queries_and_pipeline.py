"""Registered queries against their SQL, and the pipeline stage by stage."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import TABLES, rows
from maskwright.llm import queries, storage

from .test_minmax_dedup import brute as near_classes
from .test_winnowing import brute as benchmark_hits

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    answer = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, answer.fetchall())


def test_all_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_token_count_query_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    want = set()
    for r in queries.table(spark, FOLDER, "documents").collect():
        n = len(model.encode(r.text or ""))
        want.add((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert {tuple(r) for r in queries.QUERIES["op12_bpe_counts"](spark, FOLDER).collect()} == want


def test_suffix_query_equals_brute_force(spark):
    from .test_suffix_dedup import brute, results

    docs = sorted((r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect())
    assert results(queries.QUERIES["op2_suffix_dedup"](spark, FOLDER).orderBy("doc_id")) == brute(docs)


def test_near_duplicate_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").collect()]
    sets, label = near_classes(docs, 3, 85)
    lowest = {}
    for (i, _), c in zip(docs, label):
        lowest[c] = min(lowest.get(c, i), i)
    found = queries.QUERIES["op5_minmax_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), lowest[c]) for (i, _), s, c in zip(docs, sets, label)}


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, storage.stored(stage(spark, docs, FOLDER), "test-stage")
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "tokens":
            assert docs.columns == before.columns
        else:
            assert all(r.n_tokens == len(r.token_ids) for r in docs.collect())
    _, label = near_classes(kept["quality"], 5, 80)
    first = {}
    for (i, _), c in zip(kept["quality"], label):
        first[c] = min(first.get(c, i), i)
    assert sorted(i for i, _ in kept["near duplicates"]) == sorted(first.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in kept["decontamination"]) == sorted(i for i, t in kept["near duplicates"] if not benchmark_hits(t, items)[1])
    assert sorted(i for i, _ in kept["secrets"]) == sorted(i for i, _ in kept["decontamination"]) == sorted(i for i, _ in kept["tokens"])
    assert not any("password=" in t for _, t in kept["secrets"] if t)
    since = storage.mark(spark)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert storage.mark(spark) == since + 1  # only the result is left
    assert sorted((r.doc_id, r.text) for r in whole.collect()) == sorted(kept["tokens"])


def test_pipeline_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0

"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_linked_secrets", oracles.secrets_sql())
def linked_secrets_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import linked_secrets as s

    found = s.scan(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(s.listed("strong"), 256).alias("base_sha256"), s.listed("spans").alias("spans"),
    )


@query("op10_winnowing", oracles.WINNOWING)
def winnowing_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import winnowing

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = winnowing.hits(docs, table(spark, folder, "benchmark"))
    return found.selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256) as items_sha256", "n_hit > 0 as contaminated"
    )


@query("op2_suffix_dedup")
def suffix_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.without_repeats(table(spark, folder, "documents").select("doc_id", "text")).drop("kept")


@query("op3_quality_votes")
def quality_votes_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import quality_votes

    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts = [f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality_votes.verdicts(docs).selectExpr("doc_id", *counts, "base_failed", "kept", "round(quality, 6) as quality", "m.votes")


@query("op5_minmax_dedup")
def minmax_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import minmax_dedup

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = minmax_dedup.near_duplicates(docs, words_per_shingle=3, percent=85)
    return found.selectExpr("doc_id", "n_shingles", "component_id", "doc_id <=> component_id as kept")


@query("op6_pieces")
def pieces_query(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: number of pieces, a digest of the ids joined by commas, and whether
    decoding gives the text again (with U+2581 as a space)."""
    from . import pieces as p

    table_ = p.decoded(p.encoded(table(spark, folder, "documents").select("doc_id", "text")))
    same = F.coalesce(F.col("decoded") == F.translate(F.coalesce("row.text", F.lit("")), p.MARK, " "), F.lit(False))
    return table_.select(
        "row.doc_id", F.size("pieces").cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join(F.col("pieces").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.char_length(F.coalesce("row.text", F.lit(""))).cast("bigint").alias("n_chars"), same.alias("round_trip"),
    )


@query("op4_warc", oracles.WARC)
def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import storage, warc

    where = storage.new_folder(spark, "warc")
    archives = warc.write_archives(table(spark, folder, "pages"), where)
    return warc.read_archives(archives, where, split_bytes=4 << 20, with_payload=False).drop("url", "payload")


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op7_url_rules", oracles.url_sql(URL_RULES))
def url_rules_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import url_rules

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judged(table(spark, folder, "pages"), rules)


@query("op8_language")
def language_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import language

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(f"not ({language.held_out()}) and lang is not null and text is not null"))
    found = language.predicted(docs, model)
    return found.selectExpr("doc_id", f"{language.held_out()} as held_out", "lang_pred", "round(score, 9) as score")


@query("op9_perspectives", oracles.PERSPECTIVES)
def perspectives_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import perspectives

    found = perspectives.rotated(table(spark, folder, "conversations"))
    return found.selectExpr(
        "conv_id", "perspective", "part", "n_turns", "cast(char_length(rendered) as bigint) as n_chars",
        "cast(aggregate(mask, 0, (a, m) -> a + m.end - m.start) as bigint) as n_mask_chars",
        "array_join(transform(mask, m -> concat(m.start, ':', m.end)), ',') as mask", "sha2(rendered, 256) as rendered_sha256",
    )


@query("op11_merkle_manifest", oracles.MERKLE)
def merkle_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import merkle

    one_more = {"n_chars": "cast(n_chars as decimal(20, 0)) + 1"}
    found = merkle.manifest(
        table(spark, folder, "documents"), altered=one_more, where="crc32(cast(doc_id as string)) % 7 = 0", with_proofs=False
    )
    return found.drop("proof")


@query("op12_bpe_counts")
def bpe_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import bpe_counts

    found = bpe_counts.token_counts(table(spark, folder, "documents"), ["doc_id"])
    return found.selectExpr("row.doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 as over_limit")


@query("op13_hard_negatives", oracles.HARD_NEGATIVES)
def hard_negatives_query(spark: SparkSession, folder: str) -> DataFrame:
    from . import hard_negatives

    label = "case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end"
    return hard_negatives.mined(table(spark, folder, "embeddings"), label=label)

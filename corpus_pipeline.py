"""A corpus from documents to token ids, in five stages.

Every stage reads all that its predecessor kept, as Parquet in the shared folder.  All but
the last return the columns of ``documents``; the last adds token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import linked_secrets, minmax_dedup, pieces, quality_votes, storage, winnowing

WORDS_PER_SHINGLE = 5
SIMILAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_votes.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return minmax_dedup.one_of_each(docs, words_per_shingle=WORDS_PER_SHINGLE, percent=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return winnowing.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    out = linked_secrets.masked_documents(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, with the ids of the text's pieces and their number."""
    return pieces.encoded(docs).select("row.*", F.col("pieces").alias("token_ids"), F.size("pieces").cast("bigint").alias("n_tokens"))


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The label model of the first stage is fitted by iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table, stored; what the stages stored on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = storage.mark(spark)
    for name, stage in STAGES:
        docs = storage.stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        storage.clear(spark, since, keep=docs)
    return docs

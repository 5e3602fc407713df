"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII.  Of
every window of ``WINDOW`` consecutive words, the smallest hash of its ``GRAM``-word
grams is its fingerprint, on both sides, so a shared window always shares a fingerprint.
Documents and benchmark windows meet on fingerprints; every hit is then extended to the
window's words and compared word for word.

An item with fewer words than a window is one window of all its words, whose fingerprint
is the hash of them; documents give such grams only for lengths that occur.  Nulls and
texts without words have no windows.  Repeated rows are judged alike, each for itself.
Items without an id count as one item with an empty id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

WINDOW = 10
GRAM = 4
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REACH = WINDOW - GRAM
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-casing is plain for ASCII texts and by translation for the rest, as it must
    leave letters beyond ASCII alone."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(lower, F.lit("")), NOT_WORD), lambda w: w != "")


def _pairs(df: DataFrame, column: str, distance: int, combine, out: str, drop: bool = True) -> DataFrame:
    """Combine every element with the one ``distance`` places after it."""
    a = F.col(column)
    n = F.greatest(F.size(a) - distance, F.lit(0))
    df = df.withColumn(out, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(distance + 1), n), combine))
    return df.drop(column) if drop else df


def _with_grams(df: DataFrame) -> DataFrame:
    """``ws`` to ``grams``: hashes of the GRAM words from each place on."""
    df = df.withColumn("ones", F.transform("ws", lambda w: F.xxhash64(w)))
    df = _pairs(df, "ones", 1, lambda a, b: F.xxhash64(a, b), "twos", drop=False)
    return _pairs(df, "twos", 2, lambda a, b: F.xxhash64(a, b), "grams")


def _with_minima(df: DataFrame, drop: bool = True) -> DataFrame:
    """``grams`` to ``minima``: the smallest of REACH + 1 = 7 grams from each place on."""
    df = _pairs(df, "grams", 1, lambda a, b: F.least(a, b), "min2", drop)
    df = _pairs(df, "min2", 2, lambda a, b: F.least(a, b), "min4")
    return _pairs(df, "min4", 3, lambda a, b: F.least(a, b), "minima")


def _short_grams(length: int) -> Column:
    """Hashes of all runs of ``length`` words, told apart from other lengths."""
    places = F.when(F.size("ones") >= length, F.sequence(F.lit(0), F.size("ones") - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(length), F.slice("ones", i + 1, length)))


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, window_text, fingerprint, offset): one row per window of an item."""
    df = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("ws"))
    df = _with_minima(_with_grams(df.where("size(ws) > 0")), drop=False).withColumn("n", F.size("ws"))
    long = df.where(f"n >= {WINDOW}").select("item", "ws", "grams", F.posexplode("minima").alias("at", "fingerprint")).select(
        "item", F.lit(WINDOW).alias("n"),
        F.array_join(F.slice("ws", F.col("at") + 1, WINDOW), " ").alias("window_text"), "fingerprint",
        (F.array_position(F.slice("grams", F.col("at") + 1, REACH + 1), F.col("fingerprint")) - 1).cast("int").alias("offset"),
    )
    short = df.where(f"n < {WINDOW}").select(
        "item", "n", F.array_join("ws", " ").alias("window_text"), F.xxhash64("n", "ones").alias("fingerprint"), F.lit(0).alias("offset")
    )
    return long.unionByName(short).distinct()


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hits(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, same (``xxhash64`` of the text), n_words, n_hit,
    n_items, items (sorted item ids)."""
    windows = storage.stored(benchmark_windows(items, item_id, item_text), "windows")
    distinct = windows.select("n", "window_text", "fingerprint", "offset").distinct()
    n_windows = distinct.count()
    lengths = [r.n for r in windows.where(f"n < {WINDOW}").select("n").distinct().collect()]  # at most WINDOW - 1
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))

    # which documents share a fingerprint
    df = _with_grams(source.select("doc_id", "same", words(F.col("text")).alias("ws"))).drop("ws")
    df = _with_minima(df)
    found = df.select("doc_id", "same", F.explode(F.array_distinct(F.concat("minima", *map(_short_grams, lengths)))).alias("fingerprint"))
    known = _maybe_broadcast(windows.select("fingerprint").distinct(), n_windows)
    shared = storage.stored(
        found.join(known, "fingerprint").groupBy("doc_id", "same").agg(F.collect_set("fingerprint").alias("known")), "shared-fingerprints"
    )

    # where, and the words around: the texts are read again, with the few documents that have hits
    few = _maybe_broadcast(shared.withColumnRenamed("doc_id", "s_id").withColumnRenamed("same", "s_same"), shared.count())
    df = source.join(few, F.expr("same = s_same and doc_id <=> s_id"), "left").select("doc_id", "same", "known", words(F.col("text")).alias("ws"))
    some = df.withColumn("n_words", F.size("ws")).withColumn("ws", F.expr("if(known is null, cast(array() as array<string>), ws)"))
    some = _with_grams(some)

    def places(grams: Column) -> Column:
        at = F.transform(grams, lambda g, i: F.struct(g.alias("fingerprint"), i.alias("at")))
        return F.filter(at, lambda x: F.array_contains("known", x["fingerprint"]))

    all_places = F.concat(places(F.col("grams")), *(places(_short_grams(n)) for n in lengths))
    around = F.transform(all_places, lambda x: F.struct(
        x["fingerprint"].alias("fingerprint"), x["at"].alias("at"), F.greatest(x["at"] - REACH, F.lit(0)).alias("first"),
        F.slice("ws", F.greatest(x["at"] - REACH, F.lit(0)) + 1, 2 * WINDOW).alias("near"),
    ))
    table = storage.stored(
        some.select("doc_id", "same", "n_words", F.when(F.col("known").isNotNull(), around).alias("places")), "hit-places"
    )
    candidates = table.where("places is not null").select("doc_id", "same", F.inline("places"))
    start = F.col("at") - F.col("offset")
    matched = storage.stored(
        candidates.join(_maybe_broadcast(distinct, n_windows), "fingerprint")
        .withColumn("start", start)
        .where(start >= F.col("first"))
        .where(F.array_join(F.expr("slice(near, start - first + 1, n)"), " ") == F.col("window_text"))
        .select("doc_id", "same", "start", "n", "window_text").distinct(),
        "matched-windows",
    )
    covered = matched.groupBy("doc_id", "same").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans")).select(
        F.col("doc_id").alias("c_id"), F.col("same").alias("c_same"),
        F.expr("""aggregate(spans, named_struct('end', 0, 'hit', 0),
            (a, s) -> named_struct('end', greatest(a.end, s.start + s.n), 'hit', a.hit + greatest(s.start + s.n - greatest(a.end, s.start), 0)),
            a -> a.hit)""").alias("n_hit"),
    )
    named = (
        matched.select("doc_id", "same", "window_text").distinct()
        .join(_maybe_broadcast(windows.select("item", "window_text").distinct(), windows.count()), "window_text")
        .groupBy("doc_id", "same").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumnRenamed("doc_id", "i_id").withColumnRenamed("same", "i_same")
    )
    return (
        table.select("doc_id", "same", "n_words")
        .join(covered, F.expr("same = c_same and doc_id <=> c_id"), "left")
        .join(named, F.expr("same = i_same and doc_id <=> i_id"), "left")
        .selectExpr("doc_id", "same", "cast(n_words as bigint) as n_words", "cast(coalesce(n_hit, 0) as bigint) as n_hit",
                    "cast(coalesce(size(items), 0) as bigint) as n_items", "coalesce(items, cast(array() as array<string>)) as items")
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns as they were."""
    bad = storage.stored(hits(docs, items, id_column, text, **names).where("n_hit > 0").select("doc_id", "same").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(
        _maybe_broadcast(bad, bad.count()), F.expr(f"xxhash64(row.`{text}`) = same and row.`{id_column}` <=> doc_id"), "left_anti"
    ).select("row.*")

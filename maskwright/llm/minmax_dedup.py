"""Near-duplicate documents by min-max hashing.

Every document becomes its set of distinct word shingles.  Under each permutation of
the shingle hashes both the smallest and the largest value are kept, so a signature of
2k rows costs k evaluations per shingle; both rows agree between two sets with
probability equal to their Jaccard similarity.  Bands of signature rows propose
candidates, and every link is confirmed on the full sets.

At scale: equal sets become one representative first.  A band links its members to one
centre only, which gives candidate clusters without emitting pairs.  A cluster's texts
then meet in one task, where a breadth-first search confirms links until all members
are reached or proven apart.  A cluster over ``cluster_rows`` members or
``cluster_shingles`` shingles is not gathered: members confirmed with a hub are one
class, and blocks of those not confirmed with it meet parts of all members, each pair of
a block and a part in one task.  A task counts common shingles in memory and gives no
more links than it has members and queries, so neither pairs nor their shingles are ever
rows, and no set goes to the driver.

Nulls and texts without words have no set and are linked with nothing; fewer words than
a shingle's length make one shingle of all words.  Repeated rows share a set and so a
class.  Documents without an id are linked like others; a class's id is its smallest
non-null one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .components import components
from .texthash import PIECE as LONG_TEXT
from .texthash import SPACES, U64, chained, chunks, flat, lanes, lower_ascii, mix, pieces_of_words, string_hashes, without, word_spans

ROWS = 6
PERMUTATIONS_PER_BAND = ROWS // 2
PIECE = 1 << 16
#: Pairs of a member and a query that meet in one task.
ROUND_PAIRS = 8_000_000
#: Shingles of the members, and of the queries, that meet in one task.
ROUND_SHINGLES = 1 << 20


def bands_for(percent: int, miss: float = 1e-7) -> int:
    """Bands of ``ROWS`` rows so that a pair at the threshold is missed with
    probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** ROWS))


class Shingler:
    """Distinct shingle hashes of every row of a column."""

    def __init__(self, words_per_shingle: int):
        self.k = words_per_shingle
        self.word, self.lower = without(SPACES), lower_ascii()

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, sorted within each row, and where each row's hashes begin and end."""
        data, bounds = flat(texts)
        n = len(bounds) - 1
        if not len(data):
            return np.zeros(0, U64), np.zeros(n + 1, np.int64)
        if n == 1 and len(data) > 2 * LONG_TEXT:
            found = self.long_set(data)
            return found, np.array([0, len(found)])
        data = self.lower[data]
        starts, ends, first = word_spans(data, bounds, self.word)
        words = string_hashes(data, lanes(data), starts, ends)
        per_row = np.diff(first)
        n_shingles = np.where(per_row >= self.k, per_row - self.k + 1, np.minimum(per_row, 1))
        row = np.repeat(np.arange(n), n_shingles)
        offset = np.cumsum(n_shingles) - n_shingles
        at = np.repeat(first[:-1] - offset, n_shingles) + np.arange(len(row))
        length = np.minimum(per_row, self.k)[row]
        total = length.astype(U64)
        for j in range(self.k if len(words) else 0):
            total = np.where(j < length, mix(total ^ words[np.minimum(at + j, len(words) - 1)]), total)
        ends = np.cumsum(n_shingles).tolist()
        for begin, end in zip([0, *ends], ends):
            total[begin:end].sort()
        new = np.ones(len(row), bool)
        new[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
        total, row = total[new], row[new]
        return total, np.searchsorted(row, np.arange(n + 1))


    def long_set(self, data: np.ndarray) -> np.ndarray:
        """The same for one long text, in pieces."""
        words = []
        for piece in pieces_of_words(data, self.word):
            piece = self.lower[piece]
            starts, ends, _ = word_spans(piece, np.array([0, len(piece)]), self.word)
            words.append(string_hashes(piece, lanes(piece), starts, ends))
        every = np.concatenate(words)
        width = min(self.k, len(every))
        if not width:
            return np.zeros(0, U64)
        step = 1 << 20
        shingles = [np.unique(chained(every[i : i + step + width - 1], width)) for i in range(0, len(every) - width + 1, step)]
        return np.unique(np.concatenate(shingles))


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that do not depend on the order of a set's members."""
    out = []
    for seed in (0x51ED270B0A1F39C1, 0xA24BAED4963EE407):
        sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(mix(hashes ^ U64(seed)), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signature_bands(hashes: np.ndarray, bounds: np.ndarray, n_bands: int) -> np.ndarray:
    """(rows, bands): a hash of the minima and maxima of a band's permutations."""
    n = len(bounds) - 1
    rng = np.random.default_rng(11)
    flip = rng.integers(0, 1 << 63, n_bands * PERMUTATIONS_PER_BAND, dtype=np.uint64)
    factor = rng.integers(0, 1 << 62, n_bands * PERMUTATIONS_PER_BAND, dtype=np.uint64) * U64(2) + U64(1)
    out = np.zeros((n, n_bands), U64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    at = 0
    while at < len(full):  # pieces that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + PIECE)))
        rows = full[at:to]
        x, begin = hashes[bounds[rows[0]] : bounds[rows[-1] + 1]], bounds[rows] - bounds[rows[0]]
        y = np.empty_like(x)
        for band in range(n_bands):
            total = np.full(len(rows), band + 1, U64)
            for p in range(band * PERMUTATIONS_PER_BAND, (band + 1) * PERMUTATIONS_PER_BAND):
                np.bitwise_xor(x, flip[p], out=y)
                np.multiply(y, factor[p], out=y)
                total = mix(total ^ np.minimum.reduceat(y, begin))
                total = mix(total ^ np.maximum.reduceat(y, begin))
            out[rows, band] = total
        at = to
    return out


def _signed(k: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for part in chunks(batches, "text"):
            hashes, bounds = shingler.sets(part.column("text"))
            sizes = np.diff(bounds)
            one, two = set_keys(hashes, bounds)
            bands = signature_bands(hashes, bounds, n_bands).view(np.int64)
            full = sizes > 0
            ends = np.concatenate([[0], np.cumsum(np.where(full, n_bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("same"), pa.array(sizes), pa.array(one), pa.array(two),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[full].ravel()))],
                ["doc_id", "same", "n_shingles", "one", "two", "bands"],
            )

    return run


def linked(a: int, b: int, common, percent: int):
    return 100 * common >= percent * (a + b - common)


def search(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Class of every set: breadth-first over confirmed links.  Each set is a query
    once, against those that are not reached yet."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    label = np.full(n, -1)
    _, ids = np.unique(hashes, return_inverse=True)
    mark = np.zeros(ids.max(initial=-1) + 1, bool)
    left_ids, left_rows = ids, np.repeat(np.arange(n), sizes)
    queue: list[int] = []
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue.append(seed)
        while queue:
            at = queue.pop()
            keep = label[left_rows] < 0
            if keep.sum() < 0.7 * len(keep):
                left_ids, left_rows = left_ids[keep], left_rows[keep]
            if not len(left_rows):
                queue.clear()
                break
            own = ids[bounds[at] : bounds[at + 1]]
            mark[own] = True
            common = np.bincount(left_rows[mark[left_ids]], minlength=n)
            mark[own] = False
            found = np.flatnonzero((label < 0) & (common > 0) & linked(sizes, sizes[at], common, percent))
            label[found] = seed
            queue.extend(found.tolist())
    return label


def _classes(k: int, percent: int):
    """(cluster, node, text) sorted by cluster to (node, class): one cluster at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)

        def solve(nodes: np.ndarray, hashes: list[np.ndarray]) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
            label = search(np.concatenate(hashes), bounds, percent)
            lowest = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(lowest, label, nodes)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(lowest[label])], ["node", "class"])

        open_cluster, nodes, sets = None, [], []
        for part in chunks(batches, "text"):
            hashes, bounds = shingler.sets(part.column("text"))
            cluster, node = part.column("cluster").to_numpy(), part.column("node").to_numpy()
            for i in range(part.num_rows):
                if cluster[i] != open_cluster:
                    if nodes:
                        yield solve(np.array(nodes), sets)
                    open_cluster, nodes, sets = cluster[i], [], []
                nodes.append(node[i])
                sets.append(hashes[bounds[i] : bounds[i + 1]])
        if nodes:
            yield solve(np.array(nodes), sets)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for part in chunks(batches, "text"):
            hashes, bounds = shingler.sets(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("cluster"), part.column("node"),
                 pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))],
                ["cluster", "node", "hashes"],
            )

    return run


class Queries:
    """The sets of a block, with which parts of a cluster are compared."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]):
        self.nodes, self.sizes = np.array(nodes), [len(x) for x in sets]
        self.vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(ids, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(len(self.vocabulary), bool)
        self.above = list(range(len(nodes)))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = i = self.above[self.above[i]]
        return i

    def links(self, nodes: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what all links do: each member that has one with its first
        query, and queries that share a member with each other, if they are not yet."""
        sizes = np.diff(bounds)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        ids, rows = at[known], np.repeat(np.arange(len(nodes)), sizes)[known]
        first = np.full(len(nodes), -1)
        a, b = [], []
        for i, own in enumerate(self.ids):
            self.mark[own] = True
            common = np.bincount(rows[self.mark[ids]], minlength=len(nodes))
            self.mark[own] = False
            found = np.flatnonzero((common > 0) & linked(sizes, self.sizes[i], common, percent))
            new = found[first[found] < 0]
            first[new] = i
            new = new[nodes[new] != self.nodes[i]]
            a.append(nodes[new])
            b.append(np.full(len(new), self.nodes[i]))
            for j in np.unique(first[found]).tolist():
                one, two = self.root(i), self.root(j)
                if one != two:
                    self.above[one] = two
                    a.append(self.nodes[[i]])
                    b.append(self.nodes[[j]])
        return np.concatenate(a), np.concatenate(b)


def _met(percent: int):
    """(cluster, part, block, asked, node, hashes), the queries of a block before the
    members that they meet, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, queries = None, ([], []), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cluster", "part", "block")], axis=1)
            is_query, node = batch.column("asked").to_numpy(zero_copy_only=False), batch.column("node").to_numpy()
            bounds = batch.column("hashes").offsets.to_numpy().astype(np.int64)
            hashes = batch.column("hashes").values.to_numpy().view(U64)
            same = (keys[1:] == keys[:-1]).all(axis=1) & (is_query[1:] == is_query[:-1])
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                if group != tuple(keys[begin]):
                    group, asked, queries = tuple(keys[begin]), ([], []), None
                if is_query[begin]:
                    asked[0].extend(node[begin:end].tolist())
                    asked[1].extend(hashes[bounds[i] : bounds[i + 1]].copy() for i in range(begin, end))
                    continue
                if asked[0]:
                    queries, asked = Queries(*asked), ([], [])
                if queries is not None:
                    own = hashes[bounds[begin] : bounds[end]]
                    a, b = queries.links(node[begin:end], own, bounds[begin : end + 1] - bounds[begin], percent)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _links(sets: DataFrame, queries: DataFrame, percent: int, block: int = 1) -> DataFrame:
    """Links (a, b) that connect each query with the members of its cluster that it is
    linked with, both (cluster, node, hashes).  Queries come in blocks of about
    ``ROUND_PAIRS`` pairs, not of fewer than ``block``, and neither a block nor a part of
    the members has much more than ``ROUND_SHINGLES`` shingles."""
    amount = [F.count("*").alias("n"), F.sum(F.size("hashes")).alias("s")]
    members = sets.groupBy("cluster").agg(*amount).selectExpr("cluster", "n", f"ceil(s / {ROUND_SHINGLES}) as parts")
    asked = queries.groupBy("cluster").agg(*amount).withColumnsRenamed({"n": "q", "s": "q_s"})
    pairs = f"cast(q as double) * n / parts / {ROUND_PAIRS}"
    # one row per giant cluster
    cut = F.broadcast(members.join(asked, "cluster").selectExpr(
        "cluster", "parts", f"greatest(1L, ceil(q_s / {ROUND_SHINGLES}), least(ceil(q / {block}), ceil({pairs}))) as blocks"
    ))
    rows = sets.join(cut, "cluster").selectExpr(
        "cluster", "pmod(xxhash64(node), parts) as part", "explode(sequence(0L, blocks - 1)) as block", "false as asked", "node", "hashes"
    ).unionByName(queries.join(cut, "cluster").selectExpr(
        "cluster", "explode(sequence(0L, parts - 1)) as part", "pmod(xxhash64(node, 1), blocks) as block", "true as asked", "node", "hashes"
    ))
    group = ["cluster", "part", "block"]
    return rows.repartition(*group).sortWithinPartitions(*group, F.desc("asked")).mapInArrow(_met(percent), "a bigint, b bigint")


def _giant_classes(texts: DataFrame, hubs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """(node, class) for clusters too large for one task.

    Two members that are both confirmed with the hub are one class, so the only pairs
    left have a member that is not.  Those members are the queries against all members
    of the giant clusters.  No set leaves the executors.
    """
    sets = storage.stored(texts.mapInArrow(_sets(k), "cluster bigint, node bigint, hashes array<bigint>"), "giant-sets")
    if sets.groupBy("node").count().where("count > 1").take(1):  # repeated rows
        sets = storage.stored(sets.dropDuplicates(["node"]), "giant-sets-once")
    hubs = F.broadcast(hubs)  # one row per giant cluster
    links = storage.stored(_links(sets, sets.join(hubs, ["cluster", "node"], "left_semi"), percent), "hub-links")
    reached = links.selectExpr("a as node").unionByName(hubs.select("node")).distinct()
    apart = sets.join(reached, "node", "left_anti")
    near = storage.stored(_links(sets, apart, percent, block), "apart-links")
    return sets.select("node").join(components(links.unionByName(near)), "node", "left").selectExpr("node", "coalesce(component, node) as class")


def near_duplicates(
    docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text",
    cluster_rows: int = 4000, cluster_shingles: int = 4_000_000, block: int = 256,
) -> DataFrame:
    """(doc_id, same, n_shingles, class, component_id) for every row of ``docs``; ``same``
    is ``xxhash64`` of the text and tells rows of one id apart, ``class`` numbers the
    class and is null without a set."""
    spark = docs.sparkSession
    source = docs.selectExpr(f"`{id_column}` as doc_id", f"xxhash64(`{text}`) as same", f"`{text}` as text")
    signed = source.mapInArrow(
        _signed(words_per_shingle, bands_for(percent)),
        f"doc_id {source.schema['doc_id'].dataType.simpleString()}, same bigint, n_shingles bigint, one bigint, two bigint, bands array<bigint>",
    ).withColumn("node", F.monotonically_increasing_id())
    signed = storage.stored(signed, "signatures")

    # one node per distinct set
    sets = storage.stored(
        signed.where("n_shingles > 0").groupBy("n_shingles", "one", "two").agg(F.min("node").alias("node"), F.min("doc_id").alias("lowest")),
        "sets",
    )
    bands = signed.join(sets.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("band"))
    centres = storage.stored(bands.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    edges = storage.stored(
        bands.join(centres, "band").where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n")), "candidates"
    )
    clusters = storage.stored(
        components(edges.selectExpr("node as a", "centre as b"))
        .join(signed.select("node", "doc_id", "same", "n_shingles"), "node")
        .withColumnRenamed("component", "cluster"),
        "clusters",
    )
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    giants = storage.stored(sizes.where(f"n > {cluster_rows} or s > {cluster_shingles}").select("cluster"), "giants")
    any_giant = bool(giants.take(1))

    small = clusters.join(giants, "cluster", "left_anti") if any_giant else clusters
    schema = "node bigint, class bigint"
    classes = (
        _with_texts(small, source).repartition("cluster").sortWithinPartitions("cluster")
        .mapInArrow(_classes(words_per_shingle, percent), schema)
    )
    if any_giant:
        large = clusters.join(giants, "cluster", "left_semi")
        degrees = edges.groupBy("centre").agg(F.sum("n").alias("n")).withColumnRenamed("centre", "node")
        hubs = large.join(degrees, "node").groupBy("cluster").agg(F.max_by("node", F.struct("n", "node")).alias("node"))
        classes = classes.unionByName(_giant_classes(_with_texts(large, source), hubs, words_per_shingle, percent, block))
    classes = storage.stored(classes, "classes").distinct()

    named = sets.join(classes, "node", "left").selectExpr("n_shingles", "one", "two", "lowest", "coalesce(class, node) as class")
    named = storage.stored(named, "named")
    lowest = storage.stored(named.groupBy("class").agg(F.min("lowest").alias("component_id")), "lowest")
    keys = ["n_shingles", "one", "two"]
    return (
        signed.drop("bands", "node")
        .join(named.drop("lowest").join(lowest, "class"), keys, "left")
        .selectExpr("doc_id", "same", "n_shingles", "class", "coalesce(component_id, doc_id) as component_id")
    )


def _with_texts(members: DataFrame, source: DataFrame) -> DataFrame:
    """Texts of the members.  Always by a merge join: members are a share of the corpus."""
    m = members.selectExpr("cluster", "node", "doc_id as m_id", "same as m_same").hint("merge")
    return source.join(m, F.expr("same = m_same and doc_id <=> m_id")).select("cluster", "node", "text")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each class, all columns as they were.
    The smallest id stays, rows without an id only if the class has none; among rows of
    one id the text with the smallest hash, once.  Rows without a set all stay."""
    found = storage.stored(near_duplicates(docs, id_column=id_column, text=text, **options), "classes-by-row")
    best = found.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "same")).alias("best"))
    kept = best.select("best.doc_id", "best.same", F.lit(True).alias("in_class")).unionByName(
        found.where("class is null").select("doc_id", "same", F.lit(False).alias("in_class")).distinct()
    )
    rows = docs.select(F.struct("*").alias("row")).join(
        kept.hint("merge"), F.expr(f"xxhash64(row.`{text}`) = same and row.`{id_column}` <=> doc_id")
    )
    if found.where("class is not null").groupBy("doc_id", "same").count().where("count > 1").take(1):
        rows = rows.where("in_class").dropDuplicates(["doc_id", "same"]).unionByName(rows.where("not in_class"))
    return rows.select("row.*")

"""Hard negatives: rows of another label that score close below an anchor's positives.

Every row is stored with an index of one-bit codes.  A vector is turned by a random
rotation (signs and Hadamard transforms); the signs of its components are a code vector,
and its inner product with the turned vector, the alignment, is stored beside it.  What
the code leaves over stands at a right angle to it; it is turned and coded again, several
times, and the length of the last rest is stored.

A score is the sum of alignment times <anchor, code> over the codes, plus <anchor, rest>.
The first part is estimated by popcounts: the anchor's components are rounded to a few
bits, whose planes meet the code's bits.  The rounding error is known per anchor, and the
rest is bounded by Cauchy-Schwarz, with the anchor's part along the last code taken off.
Both together make an interval that holds the score for certain.  Rows whose interval
cannot reach an anchor's best rows so far are dropped; only the others are scored, in
integers.

The search is one job per step: blocks of anchors meet parts of the rows, every pair of
both in a group of its own that streams the rows past the anchors.  The first step finds
the positives among the rows of the anchor's label, the second the negatives.

Rows without id or label, and vectors that are null or hold a null or non-finite number,
take no part.  Vectors of different lengths are filled up with zeros, so an empty one
scores 0.  A component beyond a long, and a score beyond it, is the largest or smallest
long.  Of rows that share an id the one with the smallest label, then vector, counts.
Equal scores go by id.  An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage

LEVELS = 4  # codes of a row
PLANES = 7  # bits of an anchor's rounded components
ANCHORS = 4096  # of a block
ROWS = 1 << 20  # of a part, at most
PAIRS = 1 << 19  # estimated at a time
TASKS_PER_CORE = 4
SLACK = 1e-9  # for rounding in floating point, as a share of both lengths
INDEX = "id bigint, label bigint, ints array<bigint>, codes binary, align array<double>, rest double, norm double"
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
MIX = np.array([0x9E3779B97F4A7C15], np.uint64)


def width_of(components: int) -> int:
    """Components after filling up: a power of two, in whole words of 64 bits."""
    return max(64, 1 << max(components - 1, 0).bit_length())


def turned(x: np.ndarray, level: int) -> np.ndarray:
    """The rows of ``x`` under the rotation of a level: twice, random signs and a Hadamard transform."""
    n = x.shape[1]
    signs = np.random.default_rng(1000 + level).integers(0, 2, (2, n)) * 2.0 - 1.0
    for sign in signs:
        x = x * sign
        half = 1
        while half < n:
            pairs = x.reshape(len(x), n // (2 * half), 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
            half *= 2
        x = x / np.sqrt(n)
    return x


def coded(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as words (rows, levels, words), alignments and the length of the last rest."""
    n = x.shape[1]
    words, align = [], []
    for level in range(levels):
        x = turned(x, level)
        up = x >= 0
        words.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64))
        along = np.abs(x).sum(axis=1) / np.sqrt(n)
        align.append(along)
        x = x - np.where(up, 1.0, -1.0) * (along / np.sqrt(n))[:, None]
    return np.stack(words, axis=1), np.stack(align, axis=1), np.sqrt((x * x).sum(axis=1))


class Anchors:
    """A block of anchors, ready to estimate scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, levels: int):
        self.ids, self.labels, self.ints = ids, labels, ints
        x, n = ints.astype(float), ints.shape[1]
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.low, self.step, self.total, self.error, planes = [], [], [], [], []
        for level in range(levels):
            x = turned(x, level)
            low = x.min(axis=1)
            step = np.maximum(x.max(axis=1) - low, 1e-300) / ((1 << PLANES) - 1)
            rounded = np.rint((x - low[:, None]) / step[:, None])
            off = np.abs(x - (low[:, None] + step[:, None] * rounded)).sum(axis=1) / np.sqrt(n)
            bits = rounded.astype(np.int64)
            planes.append(np.stack([np.packbits(bits >> p & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)], axis=1))
            self.low.append(low), self.step.append(step), self.error.append(off)
            self.total.append(low * n + step * rounded.sum(axis=1))
        self.planes = np.stack(planes, axis=1)  # (anchors, levels, planes, words)

    def interval(self, some: np.ndarray, codes: np.ndarray, align: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of some anchors (rows) with coded rows (columns)."""
        n = self.ints.shape[1]
        middle = np.zeros((len(some), len(codes)))
        spread = SLACK * self.norm[some][:, None] * norm[None, :] + 1e-6
        for level in range(codes.shape[1]):
            up = np.zeros((len(some), len(codes)))  # sum of the rounded components where the code is positive
            ones = np.bitwise_count(codes[:, level]).sum(axis=1, dtype=np.int64)
            for plane in range(PLANES):
                common = np.zeros((len(some), len(codes)), np.uint16)
                for word in range(codes.shape[2]):
                    common += np.bitwise_count(self.planes[some, level, plane, word][:, None] & codes[None, :, level, word])
                up += common * float(1 << plane)
            up *= self.step[level][some][:, None]
            up += self.low[level][some][:, None] * ones[None, :]
            along = (2 * up - self.total[level][some][:, None]) / np.sqrt(n)  # <anchor, code>
            middle += along * align[None, :, level]
            spread += self.error[level][some][:, None] * align[None, :, level]
        least = np.maximum(np.abs(along) - self.error[-1][some][:, None], 0)
        beside = np.sqrt(np.maximum(self.norm[some][:, None] ** 2 - least**2, 0))
        spread += beside * rest[None, :]
        return np.minimum(middle - spread, 2.0**63), np.maximum(middle + spread, -(2.0**63))  # scores are held to longs


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, pair by pair, held to longs."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    exact = [min(max(sum(int(x) * int(y) for x, y in zip(p, q)), LOWEST), HIGHEST) for p, q in zip(a, b)]
    return np.array(exact, np.int64)


class Best:
    """The first ``most`` rows (highest score, then smallest id) of several searches."""

    def __init__(self, searches: int, most: int):
        self.most = most
        self.search, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: The score that a row needs at least, once a search has ``most`` rows.
        self.needed = np.full(searches, LOWEST, np.int64)

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        search, score, ids = (np.concatenate(x) for x in ((self.search, search), (self.score, score), (self.id, ids)))
        by = np.lexsort((ids, ~score, search))  # ~ turns the order around, also of the smallest long
        search, score, ids = search[by], score[by], ids[by]
        first = np.flatnonzero(np.append(True, search[1:] != search[:-1])) if len(search) else np.zeros(0, np.int64)
        rank = np.arange(len(search)) - np.repeat(first, np.diff(np.append(first, len(search))))
        keep = rank < self.most
        self.search, self.score, self.id = search[keep], score[keep], ids[keep]
        full = rank == self.most - 1
        self.needed[search[full]] = score[full]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of longs as rows, filled up with zeros."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1], sizes)] = values[bounds[0] : bounds[-1]]
    return out


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles to longs, held to the range of a long."""
    x = np.floor(x)
    out = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)
    return np.where(x >= 2.0**63, HIGHEST, np.where(x < -(2.0**63), LOWEST, out))


def _indexed(width: int, levels: int, factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, (1 << 20) // width)):
                part = batch.slice(at, max(1, (1 << 20) // width))
                vectors = part.column("vector")
                bounds = vectors.offsets.to_numpy().astype(np.int64)
                sizes = np.diff(bounds)
                x = np.zeros((part.num_rows, width))
                with np.errstate(over="ignore"):
                    x[np.repeat(np.arange(part.num_rows), sizes), np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1], sizes)] = (
                        vectors.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(float) * factor
                    )
                ints = _whole(x)
                codes, align, rest = coded(ints.astype(float), levels)
                flat = ints.astype(float)
                raw = codes.reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), _lists(ints, pa.int64()),
                     pa.array([r.tobytes() for r in raw], pa.binary()), _lists(align, pa.float64()), pa.array(rest), pa.array(np.sqrt((flat * flat).sum(axis=1)))],
                    [f.split()[0] for f in INDEX.split(", ")],
                )

    return run


def index(vectors: DataFrame, levels: int = LEVELS, factor: int = 256) -> DataFrame:
    """``vectors(id, label, vector)`` with finite numbers only, as a stored table: whole
    components (floor of ``factor`` times each), codes, alignments, lengths of the last
    rest and of the vector."""
    width = width_of(vectors.agg(F.max(F.size("vector"))).first()[0] or 0)
    return storage.stored(vectors.select("id", "label", "vector").mapInArrow(_indexed(width, levels, factor), INDEX), "index")


def _searched(levels: int, search: Callable):
    """Rows of (job, is_row, ...) sorted by job, the anchors first: for every job its
    anchors are gathered (a block has a bounded number), then the rows stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, waiting, state = None, [], None

        def opened():
            table = pa.Table.from_batches(waiting).combine_chunks()
            return search(Anchors(
                table.column("id").to_numpy(), table.column("label").to_numpy(),
                _matrix(_one(table.column("ints")), _width(table.column("ints"))), levels,
            ), _one(table.column("positives")))

        for batch in batches:
            jobs = batch.column("job").to_numpy()
            edges = np.flatnonzero(np.append(True, jobs[1:] != jobs[:-1])) if len(jobs) else []
            for first, to in zip(edges, [*edges[1:], len(jobs)]):
                part = batch.slice(first, to - first)
                if jobs[first] != job:
                    if state is not None:
                        yield state.result()
                    job, waiting, state = jobs[first], [], None
                is_row = part.column("is_row").to_numpy(zero_copy_only=False).astype(bool)
                n = int(np.argmax(is_row)) if is_row.any() else len(is_row)
                if n:
                    waiting.append(part.slice(0, n))
                rows = part.slice(n)
                if not rows.num_rows or not waiting:
                    continue
                state = state or opened()
                width = state.anchors.ints.shape[1]
                most = max(1, PAIRS // max(len(state.anchors.ids), width))
                for at in range(0, rows.num_rows, most):
                    some = rows.slice(at, most)
                    codes = np.frombuffer(b"".join(some.column("codes").to_pylist()), np.uint64).reshape(some.num_rows, levels, width // 64)
                    state.meet(
                        some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("ints"), width), codes,
                        some.column("align").flatten().to_numpy().reshape(some.num_rows, levels),
                        some.column("rest").to_numpy(), some.column("norm").to_numpy(),
                    )
        if state is not None:
            yield state.result()

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def _width(column: pa.ChunkedArray) -> int:
    return len(column.chunk(0).slice(0, 1).flatten())


class Positives:
    """The best rows of the anchor's own label."""

    COLUMNS = "anchor bigint, score bigint, id bigint"

    def __init__(self, most: int, anchors: Anchors):
        self.anchors, self.best = anchors, Best(len(anchors.ids), most)

    def meet(self, ids, labels, ints, codes, align, rest, norm) -> None:
        anchors = self.anchors
        for label in np.intersect1d(labels, anchors.labels):
            rows, some = np.flatnonzero(labels == label), np.flatnonzero(anchors.labels == label)
            _, high = anchors.interval(some, codes[rows], align[rows], rest[rows], norm[rows])
            a, r = np.nonzero((high >= self.best.needed[some][:, None]) & (anchors.ids[some][:, None] != ids[rows][None, :]))
            a, r = some[a], rows[r]
            self.best.add(a, scores(anchors.ints[a], ints[r]), ids[r])

    def result(self) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.anchors.ids[b.search], b.score, b.id)], ["anchor", "score", "id"])


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` hundredths of whole numbers, rounded up or down, within longs."""
    whole, rest = np.floor_divide(score, 100), np.mod(score, 100) * percent
    return whole * percent + (-(-rest // 100) if up else rest // 100)


class Negatives:
    """The best rows of other labels whose score lies in a band below each positive's."""

    COLUMNS = "anchor bigint, positive bigint, positive_score bigint, score bigint, id bigint"

    def __init__(self, most: int, low: int, high: int, anchors: Anchors, positives: pa.ListArray):
        self.anchors = anchors
        bounds = positives.offsets.to_numpy().astype(np.int64)
        values = positives.values.slice(bounds[0], bounds[-1] - bounds[0])
        self.of = np.repeat(np.arange(len(anchors.ids)), np.diff(bounds))  # the anchor of each search
        self.positive, self.score = values.field("id").to_numpy(), values.field("score").to_numpy()
        self.least, self.most = self.bands(low, high)
        self.best = Best(len(self.of), most)
        self.first = bounds[:-1] - bounds[0]
        self.n = np.diff(bounds)

    def bands(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        return share(self.score, low, True), share(self.score, high, False)

    def meet(self, ids, labels, ints, codes, align, rest, norm) -> None:
        anchors = self.anchors
        every = np.arange(len(anchors.ids))
        low, high = anchors.interval(every, codes, align, rest, norm)
        other = anchors.labels[:, None] != labels[None, :]
        floor = np.maximum(self.least, self.best.needed)
        reach = np.zeros(other.shape, bool)
        for k in range(int(self.n.max(initial=0))):  # the k-th positive of all anchors that have one
            some = np.flatnonzero(self.n > k)
            at = self.first[some] + k
            reach[some] |= (high[some] >= floor[at][:, None]) & (low[some] <= self.most[at][:, None])
        a, r = np.nonzero(reach & other)
        found = scores(anchors.ints[a], ints[r])
        times = self.n[a]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        search = np.repeat(self.first[a], times) + nth
        score, row = np.repeat(found, times), np.repeat(r, times)
        good = (score >= floor[search]) & (score <= self.most[search])
        self.best.add(search[good], score[good], ids[row[good]])

    def result(self) -> pa.RecordBatch:
        b = self.best
        columns = (self.anchors.ids[self.of[b.search]], self.positive[b.search], self.score[b.search], b.score, b.id)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "positive", "positive_score", "score", "id"])


def _jobs(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """All pairs of a block of anchors and a part of the rows, each as one job."""
    blocks = -(-n_anchors // ANCHORS) or 1
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n_rows // ROWS), -(-TASKS_PER_CORE * cores // blocks), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: f"pmod(xxhash64(id, {n}), {n})"
    none = F.lit(None)
    table = rows.select(F.lit(True).alias("is_row"), "*", none.cast(anchors.schema["positives"].dataType).alias("positives"), F.expr(place(parts)).alias("part"))
    table = table.select("*", every(blocks).alias("block")) if blocks > 1 else table.withColumn("block", F.lit(0))
    few = anchors.select(F.lit(False).alias("is_row"), *[c for c in anchors.columns if c != "positives"], "positives", F.expr(place(blocks)).alias("block"))
    few = few.select("*", every(parts).alias("part"))
    jobs = table.unionByName(few).select((F.col("part") * blocks + F.col("block")).alias("job"), "*").drop("part", "block")
    return jobs.repartition("job").sortWithinPartitions("job", "is_row")


def _first(df: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mined(
    vectors: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", anchors: str = "id % 100 = 0",
    n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, levels: int = LEVELS, factor: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is SQL over ``id`` and ``label``; labels may be any whole numbers.  A
    negative's score lies between ``low`` and ``high`` percent of the positive's."""
    rows = vectors.selectExpr(f"cast(`{id_column}` as bigint) as id", f"cast(({label}) as bigint) as label", f"`{vector}` as vector").where(
        "id is not null and label is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    if rows.groupBy("id").count().where("count > 1").take(1):
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")
    table = index(rows, levels, factor)
    chosen = table.where(anchors)
    n_rows, n_anchors = table.count(), chosen.count()
    positive = "array<struct<score: bigint, id: bigint>>"
    found = _jobs(table, chosen.withColumn("positives", F.lit(None).cast(positive)), n_rows, n_anchors)
    found = found.mapInArrow(_searched(levels, lambda a, _: Positives(n_positives, a)), Positives.COLUMNS)
    best = _first(found, ["anchor"], n_positives).groupBy("anchor").agg(F.collect_list(F.struct("score", "id")).alias("positives"))
    best = storage.stored(best, "positives")
    asked = storage.stored(chosen.join(best, chosen["id"] == best["anchor"]).drop("anchor"), "anchors")
    found = _jobs(table, asked, n_rows, n_anchors).mapInArrow(
        _searched(levels, lambda a, p: Negatives(n_negatives, low, high, a, p)), Negatives.COLUMNS
    )
    return _first(found, ["anchor", "positive"], n_negatives).selectExpr(
        "anchor as anchor_id", "positive as positive_id", "rank", "id as negative_id", "positive_score", "score as negative_score"
    )

"""Removal of repeated byte strings with suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes over it also starts earlier: in a
document with a smaller id, or earlier in the same one.  Strings are judged on the input.

Every window of LENGTH bytes is filed under the smallest hash of its ``GRAM``-byte grams.
Equal windows have equal smallest hashes, so all places of a string meet under one
anchor, whatever document they are in.  The windows of a document that follow each other
under one anchor are one segment.

1. Equal segments collapse to the earliest one, first inside each task and then under
   their anchor: all others repeat it whole.  So copies, in whatever number, reach the
   next step once.
2. Where different segments share an anchor, or a segment holds its anchor twice, they
   form a shard.  Its suffix array is made
   by induced sorting (``induced.suffix_array``: classify, sort leftmost-smaller
   substrings recursively, induce), common prefixes are computed in text order, and
   windows with a common prefix of LENGTH bytes with an earlier one are removed.
3. An anchor with more than ``most_segments`` different segments is not gathered.  Its
   segments are cut into single windows, which collapse as in step 1.

Nulls are empty texts.  Rows that share an id and a text are one document given several
times and get the same result; rows that share an id only are ordered by a hash of their
texts.  Documents without an id come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .induced import permuted_common_prefixes, suffix_array
from .texthash import U64, chunks, flat, lanes, mix, string_hashes

#: Two hashes of a window.  Spark chains the columns of a hash, so the seed of the second
#: has to come first: after the window it would only be a function of the first hash.
ROUTE, CONTENT = "xxhash64(body)", "xxhash64(1, body)"
LENGTH = 100
GRAM = 32
LONGEST = 256  # windows of a segment
SHARD_BYTES = 1 << 20  # of the shards that are sorted in step
PIECE = 1 << 20  # bytes of text in hand at a time
REMOVED, SHARD, CUT = 0, 1, 2
SEGMENT = "route bigint, content bigint, id bigint, tie bigint, start bigint, n bigint, again bigint"
KINDS = "kind tinyint, route bigint, id bigint, tie bigint, start bigint, n bigint"


def _table(names: str, *columns) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    kinds = {"bigint": pa.int64(), "tinyint": pa.int8()}
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(c).view(np.int64) if np.asarray(c).dtype == U64 else c, kinds[k]) for c, (_, k) in zip(columns, fields)],
        [name for name, _ in fields],
    )


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def gram_hashes(at_lane: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from every one of ``n`` places on."""
    width, out = 8, mix(np.ascontiguousarray(at_lane[: n + GRAM - 8]))
    while width < GRAM:
        out = mix(out[:-width] * U64(0xD6E8FEB86659FD93) ^ out[width:])
        width *= 2
    return out


class Cutter:
    """Segments of a piece of the corpus."""

    def segments(self, data: np.ndarray, bounds: np.ndarray):
        """(row, first place, windows, anchor, content, again) of every segment; ``again``
        if its anchor stands in it twice, so that it may repeat a string of its own."""
        n = len(data) - LENGTH + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2 + (np.zeros(0, bool),)
        at_lane = lanes(data)
        grams = gram_hashes(at_lane, len(data) - GRAM + 1)
        least = sliding_least(grams, LENGTH - GRAM + 1)
        whole = np.diff(bounds) >= LENGTH
        edge = np.zeros(n + 1, np.int8)
        edge[bounds[:-1][whole]] = 1
        last = bounds[1:][whole] - LENGTH + 1
        np.subtract.at(edge, last, 1)  # a window's row may begin where another's windows end
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        new[bounds[:-1][whole]] = True
        first = np.flatnonzero(new)
        row = np.searchsorted(bounds, first, "right") - 1
        stop = np.minimum(np.append(first[1:], n), bounds[row + 1] - LENGTH + 1)
        windows = stop - first
        again = self.twice(grams, least, first, windows)
        anchor = least[first]
        del grams, least
        pieces = -(-windows // LONGEST)  # long runs of one anchor are cut
        if len(pieces) and pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            row, stop, first = np.repeat(row, pieces), np.repeat(stop, pieces), np.repeat(first, pieces) + nth * LONGEST
            again, anchor = np.repeat(again, pieces), np.repeat(anchor, pieces)
            windows = np.minimum(stop - first, LONGEST)
        return row, first, windows, mix(anchor), string_hashes(data, at_lane, first, first + windows + LENGTH - 1), again

    def twice(self, grams: np.ndarray, least: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Whether the anchor of a run of windows stands in it more than once."""
        width = LENGTH - GRAM + 1
        around = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
        anchors = np.flatnonzero(~sliding_least(~around, width) == grams)
        values, of = np.unique(grams[anchors], return_inverse=True)
        places = np.sort(of * (len(grams) + 1) + anchors)
        key = np.searchsorted(values, least[first]) * (len(grams) + 1) + first
        return np.searchsorted(places, key + windows + width - 1) - np.searchsorted(places, key) > 1


def earliest(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Marks the first row of each key in the given order."""
    by = np.lexsort((*reversed(order), *reversed(keys)))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.logical_or.reduce([k[by][1:] != k[by][:-1] for k in keys])
    out = np.zeros(len(by), bool)
    out[by[new]] = True
    return out


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the piece, its bytes, its rows' bounds): all of it, or pieces of a long
    text, which overlap so that every window lies in one of them."""
    if len(data) <= 2 * PIECE or len(bounds) > 2:
        yield 0, data, bounds
        return
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        part = data[at : at + PIECE + LENGTH - 1]
        yield at, part, np.array([0, len(part)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = Cutter()
    for part in chunks(batches, "text", PIECE):
        whole, rows = flat(part.column("text"))
        every_id, every_tie = part.column("id").to_numpy(), part.column("tie").to_numpy()
        for at, data, bounds in _pieces(whole, rows):
            row, first, windows, anchor, content, again = cutter.segments(data, bounds)
            ids, ties = every_id[row], every_tie[row]
            start = first - bounds[row] + at
            live = earliest((anchor, content), (ids, ties, start))
            # a repetition found here needs no meeting; it travels with its document
            route = np.where(live, anchor, mix(ids.view(U64) ^ mix(start.astype(U64))))
            yield _table(SEGMENT, route, content, ids, ties, start, np.where(live, windows, -windows), again.astype(np.int64))


def _collapse(most_segments: int):
    """Segments sorted by (route, content, id, tie, start) to rows of three kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (route, content) before this batch
        held: list[np.ndarray] = []  # first segments of the open route, at most most_segments
        held_route, n_held, crowded = None, 0, False

        def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
            return _table(KINDS, np.full(len(rows), kind, np.int8), *rows[:, [0, 2, 3, 4, 5]].T.copy())

        def close():
            nonlocal held, n_held, crowded
            rows = np.concatenate(held) if held else np.zeros((0, 7), np.int64)
            done = out(CUT if crowded else SHARD, rows) if len(rows) and (crowded or n_held > 1 or rows[:, 6].any()) else None
            held, n_held, crowded = [], 0, False
            return done

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(7)], axis=1)
            gone = rows[:, 5] < 0
            if gone.any():
                known = rows[gone]
                known[:, 5] *= -1
                yield out(REMOVED, known)
                rows = rows[~gone]
                if not len(rows):
                    continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            new[0] = last is None or tuple(rows[0, :2]) != last
            last = tuple(rows[-1, :2])
            if not new.all():
                yield out(REMOVED, rows[~new])
            firsts = rows[new]
            if not len(firsts):
                continue
            begins = np.flatnonzero(np.append(True, firsts[1:, 0] != firsts[:-1, 0]))
            sizes = np.diff(np.append(begins, len(firsts)))
            # the first route may go on from the batch before, the last one may go on after it
            middle = np.ones(len(begins), bool)
            middle[0] = middle[-1] = False
            sure = np.repeat(middle, sizes)
            n = np.repeat(sizes, sizes)
            more = (n > 1) | (np.repeat(np.maximum.reduceat(firsts[:, 6], begins), sizes) > 0)
            for kind, some in ((SHARD, sure & more & (n <= most_segments)), (CUT, sure & (n > most_segments))):
                if some.any():
                    yield out(kind, firsts[some])
            for g in sorted({0, len(begins) - 1}):
                group = firsts[begins[g] : begins[g] + sizes[g]]
                if held_route != group[0, 0]:
                    if (done := close()) is not None:
                        yield done
                    held_route = group[0, 0]
                held.append(group)
                n_held += len(group)
                crowded = crowded or n_held > most_segments
                if crowded:
                    yield out(CUT, np.concatenate(held))
                    held = []
        if (done := close()) is not None:
            yield done

    return run


def shard_windows(route, ids, ties, starts, data: np.ndarray, bounds: np.ndarray):
    """(id, tie, start) of the repeated windows in segments grouped by route."""
    n = len(route)
    sizes = np.diff(bounds)
    group = np.cumsum(np.append(False, route[1:] != route[:-1])) if n else np.zeros(0, np.int64)
    # one character after each segment: a separator, or at the end of a group its end
    place = np.arange(len(data)) + np.repeat(np.arange(n), sizes)
    char = np.ones(len(data) + n, np.int64)
    char[place] = data.astype(np.int64) + 2
    after = bounds[1:] + np.arange(n)
    ends = np.append(group[1:] != group[:-1], True)
    char[after[ends]] = 0
    segment = np.repeat(np.arange(n), sizes + 1)
    key = group[segment] * 258 + char
    used = np.zeros(int(key.max()) + 1, bool)
    used[key] = True
    s = (np.cumsum(used) - 1)[key].astype(np.int32)
    group_sizes = np.bincount(group[segment])
    array = suffix_array(s, group_sizes)
    common = permuted_common_prefixes(s, group_sizes, array, LENGTH)
    kind = np.cumsum(common[array] < LENGTH)
    whole = (after[segment] - np.arange(len(char)))[array] >= LENGTH
    places, kind = array[whole], kind[whole]
    of = segment[places]
    start = starts[of] + places - (bounds[:-1] + np.arange(n))[of]
    repeated = ~earliest((kind,), (ids[of], ties[of], start))
    return ids[of][repeated], ties[of][repeated], start[repeated]


def _shards(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Segments sorted by route, solved as many whole shards at a time as ``most`` bytes hold."""
    waiting: list[pa.RecordBatch] = []

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        route, ids, ties, starts = (table.column(c).to_numpy() for c in ("route", "id", "tie", "start"))
        body = table.column("body").cast(pa.large_binary()).combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        data, bounds = flat(body.view(pa.large_string()))
        found = shard_windows(route, ids, ties, starts, data, bounds)
        by = np.lexsort((found[2], found[1], found[0]))
        i, t, s = (x[by] for x in found)
        new = np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1))[: len(i)]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(i)))
        return _table(KINDS, np.full(len(first), REMOVED, np.int8), np.zeros(len(first), np.int64), i[first], t[first], s[first], n)

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.column("body").nbytes
        if size < most:
            continue
        route = batch.column("route").to_numpy()
        last = int(np.flatnonzero(route != route[-1])[-1]) + 1 if route[0] != route[-1] else 0
        if last == 0:
            continue  # the batch is one shard so far
        yield solve([*waiting[:-1], batch.slice(0, last)])
        waiting = [batch.slice(last)]
        size = waiting[0].column("body").nbytes
    if waiting:
        yield solve(waiting)


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of rows without overlaps; ranges that touch are one."""
    by = np.lexsort((start, row))
    row, start, end = row[by], start[by], end[by]
    reach = end.copy()
    first = np.ones(len(by), bool)
    if len(by):
        far = int(end.max()) + 2  # rows one after the other, with a gap
        reach = np.maximum.accumulate(row * far + end)
        first[1:] = (row * far + start)[1:] > reach[:-1]
        reach -= row * far
    at = np.flatnonzero(first)
    return row[at], start[at], reach[np.append(at[1:], len(by)) - 1] if len(by) else reach


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their removed ranges to counts and what is left."""
    for part in chunks(batches, "text", 2 << 20):
        data, bounds = flat(part.column("text"))
        ranges, n = part.column("ranges"), part.num_rows
        at = ranges.offsets.to_numpy().astype(np.int64)
        values = ranges.values.slice(at[0], at[-1] - at[0])
        start = values.field("start").to_numpy()
        row, start, end = merged(np.repeat(np.arange(n), np.diff(at)), start, start + values.field("n").to_numpy() + LENGTH - 1)
        gone = np.zeros(n, np.int64)
        np.add.at(gone, row, end - start)
        cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
        body, places, left = memoryview(data), np.stack([start, end], axis=1), []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            edges = [a, *(places[cuts[i] : cuts[i + 1]].ravel() + a).tolist(), b]
            left.append(b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(gone), pa.array(np.bincount(row, minlength=n)),
             pa.array(left, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in left])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def _collapsed(segments: DataFrame, most_segments: int) -> DataFrame:
    return segments.repartition("route").sortWithinPartitions("route", "content", "id", "tie", "start").mapInArrow(_collapse(most_segments), KINDS)


def repeated_ranges(source: DataFrame, most_segments: int) -> DataFrame:
    """(id, tie, start, n): runs of repeated windows of ``source(id, tie, text)``."""
    found = storage.stored(_collapsed(source.mapInArrow(_cut, SEGMENT), most_segments), "collapsed")
    open_ranges = found.where(f"kind <> {REMOVED}").groupBy("id", "tie").agg(F.collect_list(F.struct("kind", "route", "start", "n")).alias("ranges"))
    pieces = source.join(open_ranges.hint("merge"), ["id", "tie"]).withColumn("bytes", F.expr("cast(text as binary)"))
    pieces = pieces.select("id", "tie", F.expr(
        f"inline(transform(ranges, r -> struct(r.kind, r.route, r.start, r.n, substring(bytes, cast(r.start + 1 as int), cast(r.n + {LENGTH - 1} as int)) as body)))"
    )).toDF("id", "tie", "kind", "route", "start", "n", "body")
    pieces = storage.stored(pieces, "segments")
    shards = pieces.where(f"kind = {SHARD}").select("route", "id", "tie", "start", "body")
    solved = shards.repartition("route").sortWithinPartitions("route").mapInArrow(_shards, KINDS)
    single = pieces.where(f"kind = {CUT}").selectExpr(
        "id", "tie", f"inline(transform(sequence(0, n - 1), i -> struct(start + i as start, substring(body, cast(i + 1 as int), {LENGTH}) as body)))"
    ).toDF("id", "tie", "start", "body").selectExpr(f"{ROUTE} as route", f"{CONTENT} as content", "id", "tie", "start", "1L as n")
    first = single.groupBy("route", "content").agg(F.min(F.struct("id", "tie", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = single.join(first, ["route", "content"]).where("struct(id, tie, start) <> first").select("id", "tie", "start", "n")
    columns = ["id", "tie", "start", "n"]
    return found.where(f"kind = {REMOVED}").select(columns).unionByName(solved.select(columns)).unionByName(again)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most_segments: int = 24) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining
    bytes), kept_sha256."""
    unique = not docs.groupBy(id_column).count().where("count > 1").take(1)
    lowest = -(1 << 63)
    tie = "0L" if unique else f"coalesce(xxhash64(`{text}`), 0L)"
    source = docs.selectExpr(f"`{id_column}` as doc_id", f"coalesce(cast(`{id_column}` as bigint), {lowest + 1}L - 1L) as id", f"{tie} as tie", f"coalesce(`{text}`, '') as text")
    once = source.select("id", "tie", "text")
    ranges = storage.stored(repeated_ranges(once if unique else once.dropDuplicates(["id", "tie"]), most_segments), "repeated")
    grouped = ranges.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    joined = source.join(grouped.hint("merge"), ["id", "tie"], "left").select(
        "doc_id", "text", F.coalesce("ranges", F.array().cast("array<struct<start: bigint, n: bigint>>")).alias("ranges")
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_kept, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")

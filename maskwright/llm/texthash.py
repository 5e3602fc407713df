"""Vectorised hashing of words and byte strings inside tasks.

A string's hash is chained from its eight-byte lanes by scrambling after each, so it has
no algebraic structure that texts could hit (a polynomial modulo 2**64 has: for every
odd base some words and their complements collide).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U64 = np.uint64
SPACES = b"\t\n\x0b\x0c\r "
LONG = 1024  # bytes of a string from which it is hashed by itself
AT_A_TIME = 1 << 18  # strings
PIECE = 4 << 20  # bytes of a long text in hand at a time
#: The first k bytes of a lane.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on; zeros follow the data."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 8, U64, padded, 0, (1,))


def string_hashes(data: np.ndarray, at_lane: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the strings between ``starts`` and ``ends``; ``at_lane`` is ``lanes(data)``."""
    if len(starts) > AT_A_TIME:
        parts = range(0, len(starts), AT_A_TIME)
        return np.concatenate([string_hashes(data, at_lane, starts[i : i + AT_A_TIME], ends[i : i + AT_A_TIME], seed) for i in parts])
    size = ends - starts
    out = mix(size.astype(U64) ^ U64(seed))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    left = np.flatnonzero((size > 0) & (size <= LONG))
    at, size, found = starts[left], size[left], out[left]
    while len(left):
        found = mix(found ^ (at_lane[at] & FIRST[np.minimum(size, 8)]))
        size = size - 8
        going = size > 0
        if not going.all():
            out[left[~going]] = found[~going]
            left, at, size, found = left[going], at[going], size[going], found[going]
        at = at + 8
    return out


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` neighbours, in their order."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, U64)
    for k in range(width):
        out = mix(out ^ hashes[k : k + n])
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each row begins and ends.
    Nulls are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(len(texts) + 1, np.int64)
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most about ``most`` bytes of text; a longer
    text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of word bytes, which never cross rows, and
    the first word of each row (with the number of words at the end)."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = is_word[data]
    begins = inside[:-1].astype(bool)
    begins[1:] &= inside[:-2] == 0
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[first] |= inside[first] == 1
    ends = inside[:-1].astype(bool) & (inside[1:] == 0)
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    ends[last] |= inside[last] == 1
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def pieces_of_words(data: np.ndarray, is_word: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that begin and end between words."""
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data):
            gap = np.flatnonzero(is_word[data[to : to + PIECE]] == 0)
            to = to + int(gap[0]) if len(gap) else min(to + PIECE, len(data))
            if len(gap):
                break
        yield data[at:to]
        at = to


def without(skipped: bytes) -> np.ndarray:
    """Table of the bytes that are part of a word."""
    out = np.ones(256, np.int8)
    out[list(skipped)] = 0
    return out


def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out

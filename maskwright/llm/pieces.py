"""Encoding texts as vocabulary pieces by shared-prefix Viterbi, and decoding them.

A text is escaped as SentencePiece does it: a marker in front and in place of every
space.  It falls apart into marked words (markers, then other characters), which no
piece crosses.  The distinct words of a batch are sorted, which makes them the
depth-first order of their trie: the best scores of all prefixes stay on a stack, and a
word only computes those beyond what it shares with the word before.

The score of a piece is ``-log(rank + RANK_SHIFT)``: the given vocabulary keeps the rank
in which pieces were merged and no probabilities, and ranks of pieces follow Zipf's law
closely.  A character without a piece is spelled in byte pieces; ties take the longest
last piece.  Decoding joins pieces and bytes and removes the escape.

Nulls and empty texts have no pieces and decode to an empty text.  Repeated rows are
encoded alike.  U+2581 itself cannot be told from a space, so it decodes to a space.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texthash import chunks

MARK = "▁"
RANK_SHIFT = 50
BYTE_COST = 8.0
WORD = re.compile(f"{MARK}*[^{MARK}]*")
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 400_000
REMEMBERED_PIECES = 4_000_000


class Vocabulary:
    """Pieces with their scores.  Control pieces are never part of a text."""

    def __init__(self, names: list[str], kinds: list[str]):
        self.names, self.kinds = names, kinds
        first = kinds.index("normal") if "normal" in kinds else 0
        self.scored = {p: (i, -math.log(i - first + RANK_SHIFT)) for i, p in enumerate(names) if kinds[i] == "normal"}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(names) if kinds[i] == "byte"}
        #: Every end of a piece, with the piece that it is, if it is one.
        self.ends: dict[str, tuple[int, float] | None] = {p[i:]: None for p in self.scored for i in range(1, len(p))}
        self.ends.update(self.scored)
        # an unknown character always costs more than any way through pieces of one character
        self.byte_score = -math.log(len(names) + RANK_SHIFT) - BYTE_COST
        # what each piece adds to a text: bytes for byte pieces, escaped UTF-8 for the others
        self.spelled = [
            bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b""
            for p, k in zip(names, kinds)
        ]


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Names and kinds from a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) else "normal"
    return Vocabulary([model.id_to_piece(i) for i in range(n)], [kind(i) for i in range(n)])


def marked(text: str) -> list[str]:
    """The marked words of a text, each without its first marker."""
    if not text:
        return []
    words = text.split(" ")
    if "" in words or MARK in text:  # several markers in a row, which stay together
        return [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))[:-1]]
    return words


def encode_sorted(words: list[str], vocabulary: Vocabulary) -> dict[str, list[int]]:
    """Best segmentation of every word; ``words`` are sorted and distinct.  The stack has
    a score and a last piece per prefix, so memory is linear in the longest word."""
    ends, missing, byte_score, spell = vocabulary.ends.get, (), vocabulary.byte_score, vocabulary.bytes
    best = [0.0]  # best[j]: the score of the first j characters
    starts, last = [0], [-1]  # where the last piece of those begins, and its id or -1
    out: dict[str, list[int]] = {}
    before = ""
    for word in words:
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], starts[shared + 1 :], last[shared + 1 :]
        for j in range(shared + 1, len(word) + 1):
            top, at, piece = best[j - 1] + byte_score, j - 1, -1
            for i in range(j - 1, -1, -1):
                found = ends(word[i:j], missing)
                if found:
                    score = best[i] + found[1]
                    if score >= top:
                        top, at, piece = score, i, found[0]
                elif found is missing:  # no piece ends like this
                    break
            best.append(top)
            starts.append(at)
            last.append(piece)
        ids: list[int] = []
        j = len(word)
        while j:
            at, piece = starts[j], last[j]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(spell[b] for b in reversed(word[at:j].encode()))
            j = at
        ids.reverse()
        out[word] = ids
        before = word
    return out


def decode_texts(pieces: pa.ListArray, vocabulary: Vocabulary) -> list[str]:
    """The texts that lists of ids spell; a null is empty."""
    spelled = np.array(vocabulary.spelled, object)
    bounds = pieces.offsets.to_numpy()
    parts = spelled[pieces.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]].tolist()
    bounds = (bounds - bounds[0]).tolist()
    return [b"".join(parts[i:j]).decode(errors="replace")[1:] for i, j in zip(bounds[:-1], bounds[1:])]


class Encoder:
    """Encodes batches; words met before are remembered, up to a limit of words and of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)  # pieces of all remembered words, one after the other
        self.bounds = np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        found = encode_sorted(sorted(MARK + w for w in words), self.vocabulary)
        self.place.update(zip((w[1:] for w in found), range(len(self.place), len(self.place) + len(found))))
        sizes = np.fromiter(map(len, found.values()), np.int64, len(found))
        new = np.fromiter((i for ids in found.values() for i in ids), np.int32, int(sizes.sum()))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, new])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        split = [marked(t or "") for t in texts]
        if len(self.place) > REMEMBERED or len(self.ids) > REMEMBERED_PIECES:
            self.forget()
        new = set().union(*split).difference(self.place)
        if new:
            self.learn(new)
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter((w for words in split for w in map(self.place.__getitem__, words)), np.int64, int(n_words.sum()))
        sizes = self.bounds[word + 1] - self.bounds[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(self.bounds[word] - ends[:-1], sizes)
        offsets = ends[np.concatenate([[0], np.cumsum(n_words)])]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(self.ids[at]))


def _encoded(path: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_vocabulary(path))
        opened = (pa.RecordBatch.from_arrays([b.column("row"), b.column("row").field(text)], ["row", "text"]) for b in batches)
        for part in chunks(opened, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), encoder.encode(part.column("text").to_pylist())], ["row", "pieces"]
            )

    return run


def encoded(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, pieces): all columns of ``docs`` in ``row`` and the ids of the text's pieces.
    ``vocabulary`` is a path that executors can read."""
    rows = docs.select(F.struct("*").alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_encoded(vocabulary, text), f"row {kind}, pieces array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path)
        for batch in batches:
            pieces = batch.column("pieces")
            for at in range(0, batch.num_rows, 500):
                some = pieces.slice(at, 500)
                texts = decode_texts(some, vocabulary)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, 500), some, pa.array(texts, pa.string())], ["row", "pieces", "decoded"])

    return run


def decoded(table: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``decoded``: the text that the pieces of (row, pieces) spell."""
    kind = table.schema["row"].dataType.simpleString()
    return table.select("row", "pieces").mapInArrow(_decoded(vocabulary), f"row {kind}, pieces array<int>, decoded string")

"""Language identification with unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all ways to cut it into pieces, by the forward
algorithm; a text's is the product over its words.  A letter without a piece is spelled
by the vocabulary's 256 byte pieces, whose probabilities are learned like the others, so
scripts that the vocabulary lacks are told apart as well.  The vocabulary is only read;
the piece probabilities are learned by expectation-maximisation (forward-backward on
counted words) from at most about ``sample_per_language`` labelled documents of each
language, chosen by a hash of the id.

Words are runs of letters, in lower case.  The new words of a batch are sorted into a
trie, and the sums of all its nodes of one depth are computed at once, in logarithms, so
words of any length count.  Null texts and texts without a letter are ``und`` with score
0, as is everything if there is nothing to learn from.  Ties go to the language that
comes first in the alphabet.  Repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .pieces import MARK, VOCABULARY, load_vocabulary
from .texthash import chunks

LETTERS = re.compile(r"[^\W\d_]+")
SMOOTH = 0.05
ROUNDS = 2
FOLDS = 5
SAMPLE_PER_LANGUAGE = 1500
#: The table of probabilities (pieces x languages) is held by the driver and every task.
MOST_LANGUAGES = 1000
REMEMBERED = 300_000
UNIT = 1 << 20


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Pieces:
    """Normal pieces by number, then the 256 bytes, and all ends of pieces."""

    def __init__(self, path: str):
        names = list(load_vocabulary(path).scored)
        self.number = {p: i for i, p in enumerate(names)}
        self.first_byte = len(names)
        self.size = len(names) + 256
        self.ends = {p[i:]: -1 for p in names for i in range(1, len(p))} | self.number

    def spelled(self, letter: str) -> list[int]:
        """The byte pieces of a letter."""
        return [self.first_byte + b for b in letter.encode()]


class Trie:
    """Prefixes of sorted words as nodes, and for every node the pieces that end there,
    each from the node where it begins.  Node 0 is empty."""

    def __init__(self, sorted_words: list[str], pieces: Pieces):
        ends, number = pieces.ends.get, pieces.number
        self.depth = [0]
        begin: list[int] = []  # per arc: the node where its piece begins, the node where it ends, the piece
        end: list[int] = []
        piece: list[int] = []
        self.last: list[int] = []  # the node of each whole word
        self.letters: dict[str, int] = {}  # letters without a piece, numbered after all pieces
        path, before = [0], ""
        for word in sorted_words:
            word = MARK + word
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                node = len(self.depth)
                self.depth.append(j)
                for i in range(j - 1, -1, -1):
                    found = ends(word[i:j], -2)
                    if found >= 0:
                        begin.append(path[i])
                        end.append(node)
                        piece.append(found)
                    elif found == -2:
                        break
                if word[j - 1] not in number:
                    begin.append(path[j - 1])
                    end.append(node)
                    piece.append(self.letters.setdefault(word[j - 1], pieces.size + len(self.letters)))
                path.append(node)
            self.last.append(path[-1])
            before = word
        self.begin, self.end, self.piece = (np.array(x, np.int64) for x in (begin, end, piece))

    def with_letters(self, logs: np.ndarray, pieces: Pieces) -> np.ndarray:
        """Log probabilities with rows for the letters without a piece."""
        return np.concatenate([logs, *(logs[pieces.spelled(x)].sum(axis=0, keepdims=True) for x in self.letters)])


def forward(sorted_words: list[str], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Log probability of every word (rows) in every language (columns), from those of
    the pieces (``Pieces.size`` rows)."""
    trie = Trie(sorted_words, pieces)
    logs = trie.with_letters(logs, pieces)
    sums = np.zeros((len(trie.depth), logs.shape[1]))
    if len(trie.end):
        depth = np.array(trie.depth)[trie.end]
        order = np.argsort(depth, kind="stable")  # arcs of a node stay together
        begin, end, piece = trie.begin[order], trie.end[order], trie.piece[order]
        levels = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
        for a, b in zip(levels[:-1], levels[1:]):
            paths = sums[begin[a:b]] + logs[piece[a:b]]
            first = np.flatnonzero(np.append(True, end[a + 1 : b] != end[a : b - 1]))
            top = np.maximum.reduceat(paths, first)
            sizes = np.diff(np.append(first, b - a))
            total = np.add.reduceat(np.exp(paths - np.repeat(top, sizes, axis=0)), first)
            sums[end[a:b][first]] = top + np.log(total)
    return sums[trie.last] if trie.last else np.zeros((0, logs.shape[1]))


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def expected(word: str, pieces: Pieces, logs: list[float]) -> dict[int, float]:
    """How often each piece is used, over all segmentations of a word in one language."""
    word = MARK + word
    n, ends = len(word), pieces.ends.get
    arcs: list[tuple[int, int, tuple[int, ...], float]] = []
    ahead, into = [0.0] * (n + 1), [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        first = len(arcs)
        for i in range(j - 1, -1, -1):
            piece = ends(word[i:j], -2)
            if piece == -2:
                break
            if piece >= 0:
                arcs.append((i, j, (piece,), logs[piece]))
        if word[j - 1] not in pieces.number:
            spelled = tuple(pieces.spelled(word[j - 1]))
            arcs.append((j - 1, j, spelled, sum(logs[b] for b in spelled)))
        ahead[j] = _log_sum([ahead[i] + p for i, _, _, p in arcs[first:]])
    behind = [0.0] * (n + 1)
    for i, j, _, p in reversed(arcs):  # arcs are in order of their ends: what follows j is complete
        if into[j]:
            behind[j], into[j] = _log_sum(into[j]), []
        into[i].append(p + behind[j])
    out: dict[int, float] = {}
    for i, j, used, p in arcs:
        x = math.exp(ahead[i] + p + behind[j] - ahead[n])
        for piece in used:
            out[piece] = out.get(piece, 0.0) + x
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        found: Counter = Counter()
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            found.update((lang, w) for w in words(text))
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": pa.array(found.values(), pa.int64())})


def _expected(path: str, languages: list[str], probability: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, at = Pieces(path), {lang: i for i, lang in enumerate(languages)}
        logs = [c.tolist() for c in np.log(probability).T]
        total: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for piece, x in expected(word, pieces, logs[at[lang]]).items():
                    total[at[lang], piece] += round(n * x * UNIT)  # whole numbers add up alike in any order
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([k[0] for k in total], pa.int64()), "piece": pa.array([k[1] for k in total], pa.int64()),
            "n": pa.array(total.values(), pa.int64()),
        })

    return run


class Model:
    def __init__(self, languages: list[str], probability: np.ndarray):
        self.languages, self.probability = languages, probability


def learn(labelled: DataFrame, vocabulary: str = VOCABULARY, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """``labelled(doc_id, text, lang)`` to piece probabilities (pieces x languages, which
    is all that comes to the driver)."""
    pieces = Pieces(vocabulary)
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(r.lang for r in sizes)
    n_pieces = pieces.size
    probability = np.full((n_pieces, len(languages)), 1 / n_pieces)
    if not languages:
        return Model([], probability)
    share = {r.lang: min(1.0, sample_per_language / r["count"]) for r in sizes}
    chance = F.create_map(*(F.lit(x) for lang in languages for x in (lang, share[lang])))
    sample = labelled.where(F.expr("pmod(xxhash64(doc_id, 'sample'), 1000003) / 1000003.0") < F.element_at(chance, F.col("lang")))
    counted = storage.stored(
        sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "language-words",
    )
    for _ in range(ROUNDS):
        rows = (
            counted.repartition(max(1, labelled.sparkSession.sparkContext.defaultParallelism), "word")
            .mapInArrow(_expected(vocabulary, languages, probability), "lang bigint, piece bigint, n bigint")
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        )
        uses = np.zeros_like(probability)
        for r in rows:
            uses[r.piece, r.lang] = r.n / UNIT
        probability = (uses + SMOOTH) / (uses.sum(axis=0) + SMOOTH * n_pieces)
    return Model(languages, probability)


def _predicted(path: str, model: Model):
    languages, table = model.languages, model.probability

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        of_pieces = np.log(table)
        k = len(languages)
        known: dict[str, int] = {}
        logs = np.zeros((0, k))
        for part in chunks(batches, "text", 2 << 20):
            found = [words(t) for t in part.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known, logs = {}, np.zeros((0, k))
            new = sorted(set().union(*found).difference(known))
            if new and k:
                logs = np.concatenate([logs, forward(new, pieces, of_pieces)])
                known.update(zip(new, range(len(known), len(known) + len(new))))
            names, scores = [], []
            for doc in found:
                if not doc or not k:
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = logs[np.fromiter(map(known.__getitem__, doc), np.int64, len(doc))].sum(axis=0)
                best = int(total.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang_pred, score): only the text decides."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predicted(vocabulary, model), f"doc_id {kind}, lang_pred string, score double")


def held_out(id_column: str = "doc_id") -> str:
    """SQL: whether a document is kept out of learning."""
    return f"crc32(coalesce(cast(`{id_column}` as string), '')) % {FOLDS} = 0"

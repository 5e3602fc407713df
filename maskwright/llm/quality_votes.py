"""Quality rules as weak supervision.

Every rule looks at a text and votes good, bad, or abstains.  The votes of all
documents are counted by pattern (at most 3**RULES of them, whatever the corpus), and
expectation-maximisation over the counted patterns estimates how often each rule votes
"bad" on good and on bad documents.  A document stays if its posterior probability of
being good reaches a threshold: no single rule decides.

Nulls and texts without a word have no words, no symbols and no lines; they fail the
base rule.  Repeated rows are judged alike, each for itself.  On an empty table the
estimates stay at their starting values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .texthash import PIECE as LONG_TEXT
from .texthash import SPACES, chained, chunks, flat, lanes, mix, pieces_of_words, string_hashes, without, word_spans

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ROUNDS = 200
#: name, measure, "good" up to, "bad" beyond.  A null measure abstains.
RULES = (
    ("few_words", lambda m: MIN_WORDS / np.maximum(m["n_words"], 1), 0.4, 1.0),
    ("long_words", lambda m: m["word_chars"] / np.maximum(m["n_words"], 1), 9.0, 14.0),
    ("stutter", lambda m: m["n_stutters"] / np.maximum(m["n_words"], 1), 0.05, 0.3),
    ("symbols", lambda m: m["n_symbols"] / np.maximum(m["n_words"], 1), 0.02, 0.1),
    ("marked_words", lambda m: m["n_marked_words"] / np.maximum(m["n_words"], 1), 0.02, 0.1),
    ("same_lines", lambda m: np.where(m["n_lines"] > 1, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), np.nan), 0.3, 0.6),
    ("same_words", lambda m: m["n_repeat_words"] / np.maximum(m["n_words"], 1), 0.1, MAX_REPEAT_PERCENT / 100),
    ("capitals", lambda m: np.where(m["n_letters"] > 0, m["n_capitals"] / np.maximum(m["n_letters"], 1), np.nan), 0.15, 0.3),
    ("no_letter_words", lambda m: m["n_bare_words"] / np.maximum(m["n_words"], 1), 0.05, 0.2),
    ("shouting", lambda m: m["n_exclaims"] / np.maximum(m["n_words"], 1), 0.05, 0.2),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_bare_words", "n_exclaims", "n_stutters", "n_marked_words")
MEASURED = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", votes: string>"


class Counter:
    """Counts over a column of texts, all rows of a piece at once."""

    def __init__(self) -> None:
        self.word = without(SPACES)
        kind = np.zeros((6, 256), bool)
        kind[0] = self.word.astype(bool)
        kind[0, 128:192] = False  # continuation bytes, so code points are counted
        kind[1, list(SYMBOLS)] = True
        kind[2, 65:91] = kind[2, 97:123] = kind[2, 128:] = True
        kind[3, 65:91] = kind[3, 97:123] = True
        kind[4, 65:91] = True
        kind[5, 33] = True
        self.kind = kind

    def counts(self, texts: pa.Array) -> dict[str, np.ndarray]:
        data, bounds = flat(texts)
        n = len(bounds) - 1
        if not len(data):
            return {c: np.zeros(n, np.int64) for c in COUNTS}
        if n == 1 and len(data) > 2 * LONG_TEXT:
            return self.long_counts(data)
        out, words, row, starts = self.of_words(data, bounds)
        again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1]))
        out["n_stutters"] = np.bincount(row[again], minlength=n)
        out["n_repeat_words"] = self.repeated(words, row, n)
        out["n_lines"], out["n_dup_lines"] = self.lines(data, bounds, starts, n)
        return out

    def of_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The counts that look at one word at a time; hash, row and start of each word."""
        n = len(bounds) - 1
        starts, ends, first = word_spans(data, bounds, self.word)
        per_word = np.diff(first)
        row = np.repeat(np.arange(n), per_word)
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])

        def per_row(k: int) -> np.ndarray:
            total = np.zeros(n, np.int64)
            total[filled] = np.add.reduceat(self.kind[k][data], bounds[filled], dtype=np.int64)
            return total

        # a word ends before the next one begins, and what lies between holds no letter
        has_letter = np.logical_or.reduceat(self.kind[2][data], starts) if len(starts) else np.zeros(0, bool)
        marked = self.kind[1][data[starts]] | self.kind[1][data[ends - 1]]
        out = {
            "n_words": per_word, "word_chars": per_row(0), "n_symbols": per_row(1),
            "n_letters": per_row(3), "n_capitals": per_row(4), "n_exclaims": per_row(5),
            "n_bare_words": np.bincount(row[~has_letter], minlength=n), "n_marked_words": np.bincount(row[marked], minlength=n),
        }
        return out, string_hashes(data, lanes(data), starts, ends), row, starts

    def long_counts(self, data: np.ndarray) -> dict[str, np.ndarray]:
        """The counts of one long text, in pieces."""
        total, hashes, starts, at = dict.fromkeys(COUNTS, 0), [], [], 0
        for piece in pieces_of_words(data, self.word):
            out, words, _, begin = self.of_words(piece, np.array([0, len(piece)]))
            for name, value in out.items():
                total[name] += int(value[0])
            hashes.append(words)
            starts.append(begin + at)
            at += len(piece)
        words, begin = np.concatenate(hashes), np.concatenate(starts)
        del hashes, starts
        total["n_stutters"] = int((words[1:] == words[:-1]).sum())
        total["n_repeat_words"] = int(self.repeated(words, np.zeros(len(words), np.int8), 1)[0])
        lines, again = self.lines(data, np.array([0, len(data)]), begin, 1)
        total["n_lines"], total["n_dup_lines"] = int(lines[0]), int(again[0])
        return {name: np.array([total[name]]) for name in COUNTS}

    def repeated(self, words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Words that lie in a window of 8 words found twice or more in the row."""
        m = len(words) - WINDOW + 1
        if m <= 0:
            return np.zeros(n, np.int64)
        key = chained(words, WINDOW)
        whole = row[:m] == row[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        key = mix(mix(key[at]) ^ mix(row[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cover = np.bincount(at[twice], minlength=len(words) + 1) - np.bincount(at[twice] + WINDOW, minlength=len(words) + 1)
        return np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=n)

    def lines(self, data, bounds, starts, n):
        """Lines with a word, and those of them equal to an earlier line of the row."""
        cuts = np.unique(np.concatenate([bounds, np.flatnonzero(data == 10) + 1]))
        begin, end = cuts[:-1], cuts[1:].copy()
        end[data[end - 1] == 10] -= 1
        used = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
        begin, end = begin[used], end[used]
        row = np.searchsorted(bounds, begin, "right") - 1
        key = mix(string_hashes(data, lanes(data), begin, end) ^ mix(row.astype(np.uint64)))
        _, where = np.unique(key, return_index=True)
        lines = np.bincount(row, minlength=n)
        return lines, lines - np.bincount(row[where], minlength=n)


def vote(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One letter per rule: g, b or a dash."""
    marks = []
    for _, measure, good, bad in RULES:
        x = measure(counts)
        marks.append(np.where(x > bad, "b", np.where(x <= good, "g", "-")))
    out = marks[0]
    for m in marks[1:]:
        out = np.char.add(out, m)
    return out


def _measured(text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for part in chunks(_opened(batches, text_column), "text"):
            counts = counter.counts(part.column("text"))
            fields = [pa.array(counts[c].astype(np.int64)) for c in COUNTS] + [pa.array(vote(counts), pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.StructArray.from_arrays(fields, [*COUNTS, "votes"])], ["row", "measured"])

    return run


def _opened(batches, text_column):
    for batch in batches:
        row = batch.column("row")
        yield pa.RecordBatch.from_arrays([row, row.field(text_column)], ["row", "text"])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, measured): every column of ``docs`` in the struct ``row``, whatever its
    name, and the counts and votes of its text."""
    rows = docs.select(F.struct("*").alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_measured(text), f"row {kind}, measured {MEASURED}")


class LabelModel:
    """Per rule, the rate of bad votes among its votes on good and on bad documents."""

    def __init__(self, prior: float, bad_on_good: np.ndarray, bad_on_bad: np.ndarray):
        self.prior, self.bad_on_good, self.bad_on_bad = prior, bad_on_good, bad_on_bad

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability that a document with these votes is good."""
        if not patterns:
            return np.zeros(0)
        letters = np.array([list(p) for p in patterns])
        bad, good = letters == "b", letters == "g"
        like = lambda rate: bad @ np.log(rate) + good @ np.log1p(-rate)
        odds = np.log(self.prior) - np.log1p(-self.prior) + like(self.bad_on_good) - like(self.bad_on_bad)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def accuracies(self) -> list[tuple[str, float, float]]:
        """(rule, accuracy on good documents, accuracy on bad documents)."""
        return [(r[0], 1 - float(g), float(b)) for r, g, b in zip(RULES, self.bad_on_good, self.bad_on_bad)]


def fit(pattern_counts: list[tuple[str, int]], rounds: int = ROUNDS, most_false: float = 0.01) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    Bad documents start with a bad vote from a third of the rules, good ones from few.
    Rules are written to be precise, so none is taken to vote "bad" on more than
    ``most_false`` of the good documents, nor less often on bad documents than three
    times its rate on good ones; this keeps the two classes from changing places.
    """
    model = LabelModel(0.9, np.full(len(RULES), most_false), np.full(len(RULES), 0.35))
    pattern_counts = sorted(pattern_counts)
    if not pattern_counts:
        return model
    patterns = [p for p, _ in pattern_counts]
    letters, n = np.array([list(p) for p in patterns]), np.array([c for _, c in pattern_counts], float)
    bad, voted = (letters == "b") * 1.0, (letters != "-") * 1.0
    for _ in range(rounds):
        good = model.posterior(patterns)
        w = n * good, n * (1 - good)
        on_good, on_bad = ((x @ bad + p) / (x @ voted + q) for x, (p, q) in zip(w, ((0.2, 10.0), (3.5, 10.0))))
        on_good = np.clip(on_good, most_false / 20, most_false)
        on_bad = np.clip(np.maximum(on_bad, 3 * on_good), 0.01, 0.99)
        prior = float(np.clip((w[0].sum() + 9) / (n.sum() + 10), 0.5, 0.99))
        change = max(abs(on_good - model.bad_on_good).max(), abs(on_bad - model.bad_on_bad).max(), abs(prior - model.prior))
        model = LabelModel(prior, on_good, on_bad)
        if change < 1e-9:
            break
    return model


def counted(votes: DataFrame) -> list[tuple[str, int]]:
    """Documents by vote pattern: at most 3**RULES rows come to the driver."""
    return [(r.votes, r["count"]) for r in votes.groupBy("votes").count().collect()]


BASE_FAILED = f"(m.n_words < {MIN_WORDS} or 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words)"


def judged(table: DataFrame, model: LabelModel, patterns: list[str], keep_from: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``quality`` (posterior) and ``kept`` to (.., m struct).
    The posterior table has one row per pattern and so a proven size bound."""
    spark = table.sparkSession
    rows = [(p, float(q)) for p, q in zip(patterns, model.posterior(patterns))]
    posterior = F.broadcast(spark.createDataFrame(rows, "pattern string, quality double"))
    return (
        table.join(posterior, F.col("m.votes") == F.col("pattern"), "left")
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", F.expr(f"not base_failed and quality >= {keep_from}"))
    )


def verdicts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts, votes, posterior and verdict.  Texts are
    read once; only counts and votes are stored."""
    table = storage.stored(
        measured(docs.select(id_column, text), text).selectExpr(f"row.`{id_column}` as `{id_column}`", "measured as m"), "votes"
    )
    patterns = counted(table.select("m.votes"))
    return judged(table, fit(patterns), [p for p, _ in patterns])


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were.  The corpus is
    measured twice (to fit, to filter) rather than stored or shuffled."""
    patterns = counted(measured(docs.select(text), text).select("measured.votes"))
    table = measured(docs, text).withColumnRenamed("measured", "m")
    return judged(table, fit(patterns), [p for p, _ in patterns]).where("kept").select("row.*")

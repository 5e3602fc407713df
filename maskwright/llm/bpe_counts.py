"""Token counts by byte-pair merging on a heap and a linked list.

A text is escaped as SentencePiece does it: a marker in front and in place of every
space.  Where no piece of the vocabulary holds two neighbouring characters, no merge can
join them, so the text is cut there without any loss: before markers, around control
characters, and in long runs at every such place.  Every distinct run is merged once per
task: the pair of neighbours with the best rank (of equal ones the leftmost) is popped
from a heap and unlinked from a list of symbols, until no pair is a piece.  The number of
tokens is the number of symbols less that of merges; ids are never made.  A character
that is no piece counts as its UTF-8 bytes, which no merge joins.

Nulls and empty texts have no tokens.  Special strings in a text are ordinary text.
Rows stay as they are: repeated ones are counted alike, and a null id stays null.  Texts
are read in pieces, so memory follows the longest run that cannot be cut (about 60 bytes
a character), not the longest text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texthash import chunks

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 500_000  # runs
REMEMBERED_LENGTH = 64  # longer runs are counted each time
PIECE = 1 << 20  # characters of a text that are cut at a time
PLACE_BITS = 40
PROBES = ("", " ", "  a", "a b", f"x{MARK}y ", "a\tb\nc \n d", "x　​y\x00", "🎉é́", "<s>a</s>")


class Merges:
    """Ranks of the pieces of a vocabulary: the lower the rank, the earlier the merge."""

    def __init__(self, scores: dict[str, float]):
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items() if len(p) > 1}
        self.single = {p for p in scores if len(p) == 1}
        self.longest = max(map(len, self.rank), default=1)
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        within = {c for p in self.rank for c in p}
        if any(p[1] == MARK != p[0] for p in self.joined):
            raise ValueError("pieces that end in a marker are not supported")
        alone = re.escape("".join(map(chr, range(32))).translate({ord(c): None for c in within}))
        #: Runs of a text in which markers are spaces.
        self.runs = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +").findall
        self.known: dict[str, int] = {}

    def symbols(self, run: str) -> int:
        return sum(1 if c in self.single else len(c.encode()) for c in run)

    def merges(self, run: str) -> int:
        """How often two neighbours of a run are merged."""
        n, rank = len(run), self.rank.get
        heap = [(r << PLACE_BITS) | i for i in range(n - 1) if (r := rank(run[i : i + 2])) is not None]
        if not heap:
            return 0
        heapify(heap)
        # end[i]: where the symbol that begins at i ends, 0 once it is merged into another; begin[j]: where the symbol that ends at j begins
        make = list if n < 4096 else lambda x: array("i", x)
        end, begin = make(range(1, n + 1)), make(range(-1, n))
        places, done, longest = (1 << PLACE_BITS) - 1, 0, self.longest
        while heap:
            top = heappop(heap)
            left = top & places
            middle = end[left]
            if not middle or middle >= n:
                continue
            right = end[middle]
            if right - left > longest or rank(run[left:right]) != top >> PLACE_BITS:
                continue  # one of the two has been merged with another
            done += 1
            end[left], end[middle], begin[right] = right, 0, left
            if left:
                before = begin[left]
                if right - before <= longest and (r := rank(run[before:right])) is not None:
                    heappush(heap, (r << PLACE_BITS) | before)
            if right < n:
                after = end[right]
                if after - left <= longest and (r := rank(run[left:after])) is not None:
                    heappush(heap, (r << PLACE_BITS) | left)
        return done

    def cut(self, run: str) -> Iterator[str]:
        """The parts of a long run that no piece joins."""
        at, joined = 0, self.joined
        for i in range(1, len(run)):
            if run[i - 1 : i + 1] not in joined:
                yield run[at:i]
                at = i
        yield run[at:]

    def count(self, run: str) -> int:
        """Tokens of one run, as the text has it."""
        run = run.replace(" ", MARK)
        if len(run) <= REMEMBERED_LENGTH:
            return self.symbols(run) - self.merges(run)
        return sum(self.symbols(part) - self.merges(part) for part in self.cut(run))

    def tokens(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        total, at, text = 0, 0, " " + text.replace(MARK, " ")
        while at < len(text):
            # whole runs: a piece of the text ends before a space that follows another character
            to = at + PIECE
            while 0 < to < len(text) and not (text[to] == " " and text[to - 1] != " "):
                to = text.find(" ", to + 1)
            to = to if 0 < to < len(text) else len(text)
            runs, known = self.runs(text[at:to] if at or to < len(text) else text), self.known
            try:
                total += sum(map(known.__getitem__, runs))
            except KeyError:
                if len(known) > REMEMBERED:
                    known.clear()
                for run in runs:
                    n = known.get(run)
                    if n is None:
                        n = self.count(run)
                        if len(run) <= REMEMBERED_LENGTH:
                            known[run] = n
                    total += n
            at = to
        return total


def load_merges(path: str = VOCABULARY) -> Merges:
    """The pieces of a SentencePiece BPE model.  Raises for a model that prepares texts
    in another way than described above."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    out = Merges({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)})
    if any(out.tokens(t) != len(model.encode(t)) for t in PROBES):
        raise ValueError(f"{path} is no byte-pair model with byte fallback and a marker in front")
    return out


def _counted(path: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load_merges(path)
        opened = (pa.RecordBatch.from_arrays([b.column("row"), b.column("row").field(text)], ["row", "text"]) for b in batches)
        for part in chunks(opened, "text", 2 << 20):
            texts = part.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = pa.array([merges.tokens(t.as_py() or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("row"), sizes, counts], ["row", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, keep: list[str] | None = None, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, n_bytes, n_tokens): the columns ``keep`` (default: all but the text) of
    ``docs`` in ``row``.  ``vocabulary`` is a path that executors can read."""
    wanted = [c for c in docs.columns if c != text] if keep is None else keep
    fields = [F.col(f"`{c}`") for c in dict.fromkeys([*wanted, text])]
    rows = docs.select(F.struct(*fields).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_counted(vocabulary, text), f"row {kind}, n_bytes bigint, n_tokens bigint")
    return found if text in wanted else found.withColumn("row", F.col("row").dropFields(f"`{text}`")) if wanted else found.drop("row")

"""Where many values occur in texts: one pass over each text for all values of its file.

The values of a file and its texts are sorted into one stream, values first.  A task
builds an automaton of the values (Aho-Corasick) and runs each text through it once, in
pieces, so time is in proportion to the text, however many values there are.  Values
stay rows: there is no array of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "file string, value string, side int, n bigint, first_line bigint, other_line bigint"


class Search:
    """All values of a file."""

    def __init__(self, values: list[str]):
        self.values = values
        self.automaton = ahocorasick.Automaton()
        for i, value in enumerate(values):
            self.automaton.add_word(value, i)
        if values:
            self.automaton.make_automaton()

    def run(self, text: str) -> Iterator[tuple[int, int, int | None, int | None]]:
        """(value, how often it occurs without overlaps, the first line on which it
        occurs, another line on which it occurs) of every value that occurs; lines count
        from 1, a value over several lines is on that of its first character."""
        count: dict[int, int] = {}
        upto: dict[int, int] = {}  # where the last counted one ends
        lines: dict[int, list[int]] = {}
        line, counted = 1, 0
        for end, i in self.automaton.iter(text) if self.values else ():
            begin = end + 1 - len(self.values[i])
            if begin > counted:
                line += text.count("\n", counted, begin)
                counted = begin
            here = line if begin == counted else line - text.count("\n", begin, counted)
            seen = lines.setdefault(i, [])
            if len(seen) < 2 and here not in seen:
                seen.append(here)
            if begin >= upto.get(i, 0):
                count[i] = count.get(i, 0) + 1
                upto[i] = end + 1
        for i, seen in lines.items():
            yield i, count[i], seen[0], seen[1] if len(seen) > 1 else None


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, values, search = None, [], None
    for batch in batches:
        rows = []
        for path, side, text in zip(*(batch.column(c) for c in ("file", "side", "text"))):
            path, side = path.as_py(), side.as_py()
            if path != file:
                file, values, search = path, [], None
            if side < 0:
                values.append(text.as_py())
                continue
            search = search or Search(values)
            rows += [(path, values[i], side, *found) for i, *found in search.run(text.as_py() or "")]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in FOUND.split(", ")])


def occurrences(values: DataFrame, texts: DataFrame) -> DataFrame:
    """``values(file, value)`` and ``texts(file, side, text)`` to one row per file, side
    and value that occurs: ``n`` (without overlaps), ``first_line``, and ``other_line``,
    a line different from the first, null if there is none.  Empty values occur nowhere."""
    asked = values.where("value <> ''").select("file", "value").distinct()
    stream = asked.selectExpr("file", "-1 as side", "value as text").unionByName(
        texts.selectExpr("file", "cast(side as int) as side", "text").join(asked.select("file").distinct(), "file", "left_semi")
    )
    return stream.repartition("file").sortWithinPartitions("file", "side").mapInArrow(_found, FOUND)

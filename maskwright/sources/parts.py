"""Reading files of any size: large ones in parts that begin and end with whole lines.

A file larger than ``PART_BYTES`` falls into byte ranges.  One job surveys the ranges:
where the first line begins, how many lines end, whether a zero byte occurs, and what the
range does to the state that detectors over several lines carry from line to line (is a
concatenation or a key block possibly open?).  A range either sets that state or leaves it
as it was, so the state before a range is what the last range that set it left: a window
over one small row per range, not over text.  Each range then gets a cut, at its first
line if nothing is open there, else at its first line that ends whatever is open.  What
lies between two cuts is a part, read by the second job.

So no finding over several lines is cut.  Where one reaches over ``TOGETHER`` ranges and
more, it is cut between lines: a key block goes on as a block of its own (``inside``),
a concatenation is judged by lines.  A line of that size is cut at a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import paths
from ..session import materialize
from .corpus import LARGEST_CELL, with_content
from .listing import file_system, qualified

PART_BYTES = 32 << 20
TOGETHER = 8
LONGEST_LOOK = 1 << 20  # of a last line, to tell what it opens
TAIL = 1 << 16

LINE_END = re.compile(rb"\r\n|\r|\n")
LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
GAP = re.compile(rb"[ \t,]")
# what may open or go on over lines; rather too much than too little
OPENS = {"code": re.compile(rb"[\"'(]"), "other": re.compile(rb"-----")}
GOES_ON = {"code": re.compile(rb"[ \t\v\f\x1c-\x1f]*[\"'+)\x80-\xff]"), "other": re.compile(rb"[^ \t]*[\r\n]*\Z|[^\r\n]*(?::|-----)")}
# a key block that is really open
BEGIN = re.compile("[ \t]*[\"']?-----BEGIN [A-Z ]*PRIVATE KEY-----[\"']?[ \t]*\\Z", re.I)
KEY_LINE = re.compile("(?:[A-Za-z0-9+/]+=*|(?i:Proc-Type|DEK-Info):.*)?\\Z")

SURVEY = (
    "path string, part bigint, off bigint, first bigint, free bigint, ends bigint, free_ends bigint,"
    " open0 boolean, open1 boolean, inside0 boolean, inside1 boolean, zero boolean"
)
FILES = "path string, part bigint, parts bigint, lines_before bigint, inside boolean, length bigint, known_reason string, content binary"


class State:
    """What is open after a line: ``open``, possibly anything; ``inside``, surely a key block."""

    def __init__(self, family: str, is_open: bool, inside: bool):
        self.family, self.open, self.inside = family, is_open, inside

    def read(self, line: bytes) -> None:
        if self.family == "config":
            self.open = self.inside = False
            return
        self.open = bool(OPENS[self.family].search(line)) or (self.open and goes_on(self.family, line))
        if self.family == "other":
            text = line.rstrip(b"\r\n").decode(errors="ignore")
            self.inside = bool(BEGIN.match(text)) or (self.inside and bool(KEY_LINE.match(text)))


def goes_on(family: str, line: bytes) -> bool:
    return family != "config" and bool(GOES_ON[family].match(line))


def surveyed(body: bytes, before: bytes, after: bytes, off: int, family: str, rest) -> tuple:
    """One range of a file: ``before`` and ``after`` are the bytes next to it, ``rest()``
    the last line's bytes beyond it.  Ends of lines count where their last byte lies."""
    lone = body.count(b"\r") - body.count(b"\r\n") - (body.endswith(b"\r") and after == b"\n")
    ends = body.count(b"\n") + lone
    at = 0 if off == 0 or before == b"\n" or (before == b"\r" and body[:1] != b"\n") else None
    if at is None:
        end = LINE_END.search(body)
        at = end.end() if end and end.end() < len(body) else None
    zero = b"\0" in body
    if at is None:  # no line begins here: the state stays
        gap = GAP.search(body)
        place = gap.start() if gap else next((i for i, c in enumerate(body[:4]) if c & 0xC0 != 0x80), 0)
        return off + place, None, None, ends, 0, False, True, False, True, zero
    lines = body[at:] + rest()
    free, n = None, 1 if at else 0
    for match in LINE.finditer(lines):
        if at + match.start() >= len(body):
            break
        if not goes_on(family, match[0]):
            free = off + at + match.start()
            break
        n += 1
    states = [State(family, False, False), State(family, True, True)]
    look, last = TAIL, []
    while free is not None:  # from the last line that ends whatever is open
        last = lines[-look:].splitlines(keepends=True)[0 if look >= len(lines) else 1 :]
        begin = next((i for i in range(len(last) - 1, -1, -1) if not goes_on(family, last[i])), None)
        if begin is not None:
            last = last[begin:]
            break
        look *= 8
    for state in states:
        for line in last if free is not None else (m[0] for m in LINE.finditer(lines)):
            state.read(line)
    a, b = states
    return off, off + at, free, ends, n if free is not None else 0, a.open, b.open, a.inside, b.inside, zero


def _survey(uri: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(uri)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with system.open_input_file(f"{top}/{r['path']}") as file:
                    lead = 1 if r["off"] else 0
                    file.seek(r["off"] - lead)
                    data = file.read(lead + size + 1)
                    before, body, after = data[:lead], data[lead : lead + size], data[lead + size :]

                    def rest() -> bytes:
                        if body[-1:] == b"\n" or not after or (body[-1:] == b"\r" and after != b"\n"):
                            return b""
                        more = after + file.read(LONGEST_LOOK)
                        end = LINE_END.search(more)
                        return more[: end.end()] if end else more

                    rows.append((r["path"], r["part"], *surveyed(body, before, after, r["off"], r["family"], rest)))
            fields = [f.strip().split() for f in SURVEY.split(",")]
            kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])

    return run


def plan_parts(large: DataFrame, root: str, part_bytes: int, together: int | None = None) -> DataFrame:
    """``large(path, length, kind)`` to its parts: (path, part, parts, begin, stop,
    lines_before, inside, length, zero).  Only numbers and paths are exchanged.  With
    ``together`` 0 nothing is cut, however many ranges it reaches over."""
    spark = large.sparkSession
    together = TOGETHER if together is None else together
    ranges = large.selectExpr(
        "path", "length", "case when kind = 'config' then 'config' when kind is null then 'other' else 'code' end as family",
        f"explode(sequence(0L, cast((length - 1) div {part_bytes} as bigint))) as part",
    ).withColumn("off", F.expr(f"part * {part_bytes}"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    survey = ranges.repartition(tasks, "path", "part").mapInArrow(_survey(qualified(spark, root), part_bytes), SURVEY)
    survey = materialize(survey, "survey").join(large.select("path", "length"), "path")
    order = Window.partitionBy("path").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = lambda name: F.coalesce(F.last(F.expr(f"if({name}0 = {name}1, {name}0, null)"), True).over(before), F.lit(False))
    known = survey.withColumns({
        "is_open": held("open"), "in_block": held("inside"), "ends_before": F.coalesce(F.sum("ends").over(before), F.lit(0)),
        "any_zero": F.max("zero").over(Window.partitionBy("path")),
    })
    natural = "case when part = 0 then 0L when is_open then free else first end"
    forced = f"if(part % {together} = 0, coalesce(first, off), null)" if together else "cast(null as bigint)"
    cut = known.withColumn("cut", F.expr(f"coalesce({natural}, {forced})")).where("cut is not null")
    return cut.selectExpr(
        "path", "cast(row_number() over (partition by path order by part) - 1 as bigint) as part", "count(*) over (partition by path) as parts",
        "cut as begin", "lead(cut, 1, length) over (partition by path order by part) as stop",
        # the line that begins before the range ends in it, unless the range begins with a line
        "ends_before + case when cut = free then free_ends when cut = first and first > off then 1 else 0 end as lines_before",
        "in_block and is_open and not cut <=> free as inside", "length", "any_zero as zero",
    )


def _load(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(uri)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                begin = row.column("begin")[0].as_py()
                size, body = row.column("stop")[0].as_py() - begin, None
                if size <= LARGEST_CELL:
                    with system.open_input_file(f"{top}/{row.column('path')[0].as_py()}") as file:
                        file.seek(begin)
                        body = file.read(size)
                kept = [c for c in row.schema.names if c not in ("begin", "stop")]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), pa.array([body], pa.binary())], [*kept, "content"])

    return run


def read_lines(listed: DataFrame, root: str, part_bytes: int = 0) -> DataFrame:
    """Every file of a listing with its bytes: (path, length, part, parts, content).  A file
    larger than ``part_bytes`` comes in parts of whole lines, whatever its bytes are."""
    part_bytes = part_bytes or PART_BYTES
    tasks = 4 * listed.sparkSession.sparkContext.defaultParallelism
    files = listed.select("path", "length")
    small = with_content(files.where(f"length <= {part_bytes}").repartition(tasks, "path"), root).selectExpr("path", "length", "0L as part", "1L as parts", "content")
    large = materialize(files.where(f"length > {part_bytes}").withColumn("kind", F.lit("config")), "large-files")  # lines of which nothing goes on
    if not large.take(1):
        return small
    planned = materialize(plan_parts(large, root, part_bytes, together=0), "parts").select("path", "length", "part", "parts", "begin", "stop")
    loaded = planned.repartition(tasks, "path", "part").mapInArrow(
        _load(qualified(listed.sparkSession, root)), "path string, length bigint, part bigint, parts bigint, content binary"
    )
    return small.unionByName(loaded)


def read_files(listed: DataFrame, root: str, limits: paths.Limits = paths.Limits(), part_bytes: int = 0) -> DataFrame:
    """Files of a listing with their bytes: one row per file, or per part of a large
    one, as ``FILES``.  ``lines_before`` counts the lines of the file before a part.  A
    large file that will not be scanned is one row without content.  Other columns of the
    listing stay beside."""
    spark: SparkSession = listed.sparkSession
    part_bytes = part_bytes or PART_BYTES
    cores = spark.sparkContext.defaultParallelism
    more = [c for c in listed.columns if c not in ("path", "length")]  # goes with every part
    named = listed.withColumn("kind", F.expr(paths.classify("path")))
    large = materialize(named.where(f"length > {part_bytes}"), "large-files")
    columns = [f.split()[0] for f in FILES.split(", ")] + more
    small = with_content(named.where(f"length <= {part_bytes}").repartition(4 * cores, "path"), root)
    small = small.selectExpr("*", "0L as part", "1L as parts", "0L as lines_before", "false as inside", "cast(null as string) as known_reason").select(columns)
    if not large.take(1):
        return small
    # what no byte can change comes first, as for a file that is one cell
    large = large.withColumn("known_reason", F.expr(paths.unscanned_reason("path", "length", "X'01'", limits, "kind")))
    planned = materialize(plan_parts(large.where("known_reason is null"), root, part_bytes), "parts")
    binary = large.join(planned.where("part = 0 and zero").select("path"), "path", "left_semi").where("kind is null and known_reason is null")
    passed = large.where("known_reason is not null").unionByName(binary.withColumn("known_reason", F.lit("binary")))
    passed = passed.selectExpr("path", "length", "known_reason", "0L as part", "1L as parts", "0L as lines_before", "false as inside", "cast(null as binary) as content", *more)
    read = planned.join(materialize(binary.select("path"), "binary-files"), "path", "left_anti").drop("zero").join(large.select("path", *more), "path")
    read = read.select("path", "part", "parts", "lines_before", "inside", "length", F.lit(None).cast("string").alias("known_reason"), *more, "begin", "stop")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.drop("begin", "stop").schema)
    loaded = read.repartition(4 * cores, "path", "part").mapInArrow(_load(qualified(spark, root)), f"{kind}, content binary")
    return small.unionByName(passed.select(columns)).unionByName(loaded)

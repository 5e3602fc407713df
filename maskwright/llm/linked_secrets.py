"""Secret scan with linked parts, in DataFrame functions only.

Strong candidates stand alone: assignments to a secret's name, access identifiers of a
known form, long hexadecimal runs.  Weak candidates (a user or client id, a run of 16 or
more letters and digits, an endpoint) say little alone.  Access identifiers, secrets
and endpoints are the parts of a credential: a weak candidate is reported only if its
complementary parts lie within ``REACH`` code points in the same scope, a scope being
the text between blank lines.

- an id needs a secret in reach, a run needs an identifier, an endpoint needs both.

A weak span that overlaps a strong one is no candidate, nor is a run that overlaps an id.

The link is an interval join on bins of REACH code points: a candidate looks at its own
bin and both neighbours, and of every bin only the first and last start of each kind of
part are joined, which decides it exactly without pairing all parts of a bin.  What lies
before or after a span is decided by windows over sorted spans, and running sums inside a
row go block by block, so the work is in proportion to the number of matches.

Nulls are empty texts.  Repeated rows are scanned alike, each for itself.  Positions are
code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage

REACH = 400
#: kind, part, sign that a text may hold it, pattern, group and its least length.  In the order of reports.
STRONG = (
    ("assign", "secret", r"(?i)passw|secret|token|api_?key",
     r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "identifier", r"AKIA", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", r"[0-9a-f]{24}", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("id", "identifier", r"(?i)user|login|account|client_?id|key_?id",
     r"""(?i)(?:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 1, 3),
    ("run", "secret", r"[A-Za-z0-9+/_-]{16}",
     r"[A-Za-z0-9+/_-]{16,}={0,2}", 0, 16),
    ("endpoint", "endpoint", r"://|:[0-9]{2}", r"""(?i)[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20"'<>]+|[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}""", 0, 6),
)
RANK = {kind: i for i, (kind, *_) in enumerate((*STRONG, *WEAK))}
BLANK_LINE = r"\n[\x20\t\r]*\n"
SPAN = "array<struct<start: int, rank: int, end: int, kind: string>>"
BROADCAST_ROWS = 100_000
BLOCK = 256  # matches of a text whose places are summed up at a time
PIECE = 512  # characters


def good_value(kind: str, least: int):
    """Long enough; a run has letters and digits, and with a dash or underscore, which
    also join words, capital and small letters."""

    def test(v: Column) -> Column:
        good = F.char_length(v) >= least
        if kind != "run":
            return good
        mixed = ~v.rlike("[_-]") | (v.rlike("[A-Z]") & v.rlike("[a-z]"))
        return good & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & mixed

    return test


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(numbers: Column, combine) -> Column:
    """For each number of an array, all numbers before it combined (0 for none).  An
    array grows by copying, so it is done in blocks and then over the blocks."""
    none = F.array().cast("array<int>")

    def running(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), none.alias("out"))
        step = lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(values, state, step, lambda a: a["out"])

    def over(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine))
        return F.flatten(F.zip_with(blocks, running(whole, F.lit(0)), running))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
    return let(numbers, lambda v: F.when(F.size(v) > 0, let(cut(v), over)).otherwise(none))


def plus(a: Column, b: Column) -> Column:
    return a + b


def largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def spans(text: Column, kind: str, sign: str, pattern: str, group: int, least: int) -> Column:
    """Matches, leftmost and not overlapping, as (start, rank, end, kind).

    The pieces between the matches and the lengths of the matches give the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("long"), F.transform(value, good_value(kind, least)).alias("good"),
    )

    def placed(found: Column) -> Column:
        before = before_each(F.transform(found, lambda m: m["gap"] + F.coalesce(m["long"], F.lit(0))), plus)
        every = F.zip_with(found, before, lambda m, at: F.struct(m["good"].alias("good"), F.struct(
            (at + m["gap"]).alias("start"), F.lit(RANK.get(kind, -1)).alias("rank"), (at + m["gap"] + m["long"]).alias("end"), F.lit(kind).alias("kind")
        ).alias("span")))
        return F.transform(F.filter(every, lambda m: m["good"]), lambda m: m["span"])  # the text after the last match is no match

    return F.when(text.rlike(sign), let(found, placed)).otherwise(F.array().cast(SPAN))


def parts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, same, strong, weak, blanks): spans per text, and for texts with weak
    ones the blank lines.  Every text is read once."""
    df = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("same"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    columns = {kind: spans(t, kind, *rest) for kind, _, *rest in (*STRONG, *WEAK)}
    df = df.select("doc_id", "same", "text", *(c.alias(kind) for kind, c in columns.items()))
    strong = F.array_sort(F.concat(*(kind for kind, *_ in STRONG)))
    weak = F.concat(*(kind for kind, *_ in WEAK))
    df = df.select("doc_id", "same", "text", strong.alias("strong"), weak.alias("weak"))
    blanks = F.when(F.size("weak") > 0, spans(t, "blank", r"\n[\x20\t\r]*\n", BLANK_LINE, 0, 1)).otherwise(F.array().cast(SPAN))
    return df.select("doc_id", "same", "strong", "weak", blanks.alias("blanks"))


def candidates(table: DataFrame) -> DataFrame:
    """(doc_id, same, scope, span) of the strong spans and of the weak ones that may
    count, for texts with weak ones.  ``scope`` is the number of blank lines before."""
    rows = table.where("size(weak) > 0").select("doc_id", "same", F.explode(F.concat("strong", "weak", "blanks")).alias("span")).distinct()
    text = ["doc_id", "same"]
    strong = F.col("span.kind").isin([kind for kind, *_ in STRONG])
    blocks = {"any": strong, "run": strong | (F.col("span.kind") == "id")}
    after = Window.partitionBy(*text).orderBy(F.desc("span.start"), F.desc("span.rank"), F.desc("span.end")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*text).orderBy("span.start", "span.rank", "span.end").rowsBetween(Window.unboundedPreceding, -1)
    for name, is_block in blocks.items():
        rows = rows.withColumn(f"next_{name}", F.min(F.when(is_block, F.col("span.start"))).over(after))
    rows = rows.withColumns({
        "scope": F.coalesce(F.count(F.when(F.col("span.kind") == "blank", 1)).over(before), F.lit(0)),
        **{f"last_{name}": F.max(F.when(is_block, F.col("span.end"))).over(before) for name, is_block in blocks.items()},
    })
    free = lambda name: f"coalesce(last_{name} <= span.start, true) and coalesce(next_{name} >= span.end, true)"
    kept = strong | F.expr(f"if(span.kind = 'run', {free('run')}, {free('any')})")
    return rows.where((F.col("span.kind") != "blank") & kept).select(*text, "scope", "span")


def link(table: DataFrame) -> DataFrame:
    """(doc_id, same, linked): the weak spans whose complementary parts are in reach."""
    role = F.create_map(*(F.lit(x) for kind, part, *_ in (*STRONG, *WEAK) for x in (kind, part)))
    rows = candidates(table).select(
        "doc_id", "same", "scope", role[F.col("span.kind")].alias("part"), F.floor(F.col("span.start") / REACH).alias("bin"), "span"
    )
    bins = rows.groupBy("doc_id", "same", "scope", "part", "bin").agg(F.min("span.start").alias("first"), F.max("span.start").alias("last"))
    weak_kinds = [kind for kind, *_ in WEAK]
    looking = rows.where(F.col("span.kind").isin(weak_kinds)).select(
        "doc_id", "same", "scope", F.col("part").alias("own"), "span", F.explode(F.array(*(F.col("bin") + d for d in (-1, 0, 1)))).alias("bin")
    )
    near = looking.alias("l").join(bins.alias("b"), F.expr(
        "l.doc_id <=> b.doc_id and l.same = b.same and l.scope = b.scope and l.bin = b.bin and l.own <> b.part"
    )).where(f"b.first <= span.start + {REACH} and b.last >= span.start - {REACH}")
    met = near.groupBy("l.doc_id", "l.same", "own", "span").agg(F.collect_set("b.part").alias("met"))  # at most three parts
    linked = met.where("""case own when 'identifier' then array_contains(met, 'secret') when 'secret' then array_contains(met, 'identifier')
        else array_contains(met, 'secret') and array_contains(met, 'identifier') end""")
    return linked.groupBy("doc_id", "same").agg(F.collect_set("span").alias("linked"))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, same (``xxhash64`` of the text), strong spans and
    all spans, each sorted by start and kind."""
    table = storage.stored(parts(docs, id_column, text), "secret-parts")
    linked = storage.stored(link(table), "linked-secrets").withColumnRenamed("doc_id", "l_id").withColumnRenamed("same", "l_same")
    return table.join(linked, F.expr("same = l_same and doc_id <=> l_id"), "left").select(
        "doc_id", "same", "strong", F.array_sort(F.concat("strong", F.coalesce("linked", F.array().cast(SPAN)))).alias("spans")
    )


def listed(column: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """A text with a mask for its sorted spans; spans that overlap share one.  The text
    is cut into pieces of equal length first, in which places are found at once."""
    piece = F.lit(PIECE)

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """Characters ``a`` to ``b`` of the text."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        head = F.substring(F.get(pieces, i), a - i * piece + 1, F.when(i == j, b - a).otherwise(piece))
        rest = F.concat(F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substring(F.get(pieces, j), F.lit(1), b - j * piece))
        return F.when(a >= b, "").when(i == j, head).otherwise(F.concat(head, rest))

    def woven(spans: Column, pieces: Column) -> Column:
        # where the spans before each one end at most
        reach = before_each(F.transform(spans, lambda s: s["end"]), largest)
        gaps = F.zip_with(spans, reach, lambda s, at: F.when(s["start"] >= at, F.concat(between(pieces, at, s["start"]), F.lit(mask))).otherwise(""))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(gaps, ""), between(pieces, end, F.char_length(text)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(cut, lambda pieces: woven(spans, pieces))


def masked_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by a mask; overlapping spans share one.
    All rows and columns stay; a null text stays null."""
    found = storage.stored(scan(docs, id_column, text).where("size(spans) > 0").select("doc_id", "same", "spans").distinct(), "secrets")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    joined = docs.select(F.struct("*").alias("row")).join(found, F.expr(f"xxhash64(row.`{text}`) = same and row.`{id_column}` <=> doc_id"), "left")
    changed = F.when(F.col("spans").isNotNull(), masked(F.expr(f"row.`{text}`"), F.col("spans"), mask)).otherwise(F.expr(f"row.`{text}`"))
    return joined.select(*(changed.alias(c) if c == text else F.expr(f"row.`{c}`") for c in docs.columns))

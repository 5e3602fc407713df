"""Conversations rendered once for every participant.

For each participant the dialogue is rotated: that speaker's turns are the assistant's,
all others are named users, and the loss mask covers what the assistant says, with its
end mark.  System turns stay system turns in every rendering and are no participant.

A conversation is rendered in parts of ``TURNS`` turn numbers; the parts in order are the
whole.  Where numbers repeat or are missing, a part can hold any number of turns: one of
more than ``MOST_ROWS`` turns or ``MOST_BYTES`` of text is cut by position into pieces of
at most ``TURNS`` turns, so no conversation, also the one without an id, is one row or one
group.  Turns are gathered before they are multiplied by participants.

A null role is the participant ``unknown``, a null text is empty, turns without a number
form part -1; equal turn numbers are ordered by role and text, and repeated rows stay.
Turns without a conversation form one.  Control marks inside texts and names are broken
up by a space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

TURNS = 64
MOST_ROWS = 4096
MOST_BYTES = 64 << 20
SYSTEM = "system"
END = "<|end|>\n"


def _gathered(rows: DataFrame) -> DataFrame:
    """(conv_id, part, piece, turns): ``piece`` is 0 but for crowded parts, where it grows
    in the order of the turns.  Their rows are sorted by range, also equal ones, and cut
    by the place in their range."""
    size = F.sum(F.octet_length("speaker").cast("bigint") + F.octet_length("said"))
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), size.alias("n_bytes"))
    crowded = storage.stored(
        sizes.where(f"n > {MOST_ROWS} or n > {TURNS} and n_bytes > {MOST_BYTES}").selectExpr("conv_id as c_id", "part as c_part"), "crowded-parts"
    )
    listed = F.array_sort(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns")
    keys = ["conv_id", "part", "piece"]
    if not crowded.take(1):
        return rows.withColumn("piece", F.lit(0).cast("bigint")).groupBy(*keys).agg(listed)
    same = F.expr("conv_id <=> c_id and part = c_part")
    places = storage.stored(rows.join(crowded, same, "left_semi").withColumn("tie", F.monotonically_increasing_id()), "crowded-turns")
    order = ["conv_id", "part", "turn", "speaker", "said", "tie"]
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id is the range's number and, in the lower 33 bits, the place in it
    cut = places.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    cut = storage.stored(cut.withColumn("piece", F.expr(f"at div {TURNS}")).drop("at", "tie"), "crowded-pieces")
    rest = rows.join(crowded, same, "left_anti").withColumn("piece", F.lit(0).cast("bigint"))
    return rest.unionByName(cut).groupBy(*keys).agg(listed)


def rotated(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, part, piece, n_turns, rendered, mask): ``mask`` lists the
    assistant's spans in code points of ``rendered``, ends exclusive."""
    safe = lambda c, default: F.replace(F.coalesce(F.col(c), F.lit(default)), F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.floor(F.col(turn) / TURNS), F.lit(-1)).cast("bigint").alias("part"),
        safe(role, "unknown").alias("speaker"), safe(text, "").alias("said"),
    )
    parts = _gathered(rows)
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    both = parts.join(people, F.expr("conv_id <=> of")).drop("of")
    head = """case when t.speaker = 'system' then '<|system|>\n' when t.speaker = perspective then '<|assistant|>\n'
        else concat('<|user name=', t.speaker, '|>\n') end"""
    pieces = F.expr(f"transform(turns, t -> struct({head} as head, concat(t.said, '\n{END}') as body, t.speaker = perspective as own))")
    spans = F.expr("""aggregate(pieces, named_struct('at', 0, 'mask', cast(array() as array<struct<start: int, end: int>>)),
        (a, p) -> named_struct('at', a.at + char_length(p.head) + char_length(p.body), 'mask',
            if(p.own, concat(a.mask, array(named_struct('start', a.at + char_length(p.head), 'end', a.at + char_length(p.head) + char_length(p.body)))), a.mask)),
        a -> a.mask)""")
    return both.withColumn("pieces", pieces).select(
        "conv_id", "perspective", "part", "piece", F.size("turns").cast("bigint").alias("n_turns"),
        F.expr("array_join(transform(pieces, p -> concat(p.head, p.body)), '')").alias("rendered"), spans.alias("mask"),
    )

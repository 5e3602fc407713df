"""A Merkle manifest of a dataset: digests, inclusion proofs and their verification.

Every row is a leaf.  The leaves of one tree (rows that share ``tree``) are ordered by
``key`` and hashed in pairs, level by level, until one node remains, the subroot; a last
node without a partner is hashed alone.  The subroots, ordered by their tree's name
(null first, then by UTF-8 bytes), give the root in the same way.

A tree is cut into superblocks of 2**bits neighbouring nodes.

1. Leaves are numbered inside their trees by places in sorted ranges, so that a tree
   that holds most rows is never one task.
2. Each superblock is reduced to its top.  The tops are the nodes of a tree that is
   2**bits times smaller; they are handled in the same way until every tree is one node.
   The subroots are one more tree.
3. Going down again, the nodes of a level and the outer nodes that their proofs need are
   cogrouped by superblock: one function reduces the superblock, joins the siblings
   inside it with those outside, and folds every leaf back to the root.

A group holds a bundle of superblocks chosen by hash, so that neither one large tree nor
very many small trees make groups of another size.

Nulls are part of a leaf (``-``), also a null key or tree; null keys come first.  Rows
that share a key are leaves of their own, ordered by their digest.  Repeated rows are
leaves of their own as well; which of them has which place is open, and so is the proof
of each, but not the set of the proofs.  An empty table has an empty manifest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage

BITS = 10
BROADCAST_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "tree string, pos bigint, steps array<string>, top string"


def digest(values: list[str]) -> str:
    """SQL for the digest of a row's fields: ``-`` for a null, else length and value."""
    parts = ", ".join(f"coalesce(concat(octet_length({v}), ':', {v}), '-')" for v in values)
    return f"sha2(concat({parts}), 256)"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """A run of nodes and the levels above it."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_hash("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def steps_up(ladder: list[list[str]], at: int) -> list[str]:
    """What a node is hashed with on its way up: ``L`` or ``R`` and the sibling on that
    side, or ``-`` where it is hashed alone."""
    out = []
    for level in ladder[:-1]:
        beside = at ^ 1
        out.append(("L" if at & 1 else "R") + level[beside] if beside < len(level) else "-")
        at >>= 1
    return out


def folded(node: str, steps: list[str]) -> str:
    """The root that a node and its proof give."""
    for step in steps:
        node = _hash(step[1:] + node if step[0] == "L" else node + step[1:] if step[0] == "R" else node)
    return node


def _levels(size: int, bits: int) -> int:
    """Levels of a superblock in a tree of ``size`` nodes."""
    return min(bits, (size - 1).bit_length())


def _name(tree) -> str | None:
    return tree if isinstance(tree, str) else None


def _superblocks(nodes: pd.DataFrame, bits: int) -> Iterator[tuple[str | None, int, pd.DataFrame, list[list[str]]]]:
    """(tree, superblock, its nodes in order, its levels) of each superblock of a bundle."""
    nodes = nodes.assign(block=nodes["pos"].to_numpy() >> bits)
    for (tree, block), part in nodes.groupby(["tree", "block"], dropna=False, sort=False):
        part = part.sort_values("pos")
        yield _name(tree), int(block), part, reduced(part["hash"].tolist(), _levels(int(part["size"].iloc[0]), bits))


def _tops(bits: int):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (tree, block, -(-int(part["size"].iloc[0]) // (1 << bits)), ladder[-1][0])
            for tree, block, part, ladder in _superblocks(nodes, bits)
        ]
        return pd.DataFrame(rows, columns=["tree", "pos", "size", "hash"])

    return run


def _outside(outer: pd.DataFrame) -> dict:
    return {(_name(t), int(p)): (list(s), top) for t, p, s, top in zip(outer["tree"], outer["pos"], outer["steps"], outer["top"])}


def _paths(bits: int):
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        known, rows = _outside(outer), []
        for tree, block, part, ladder in _superblocks(nodes, bits):
            above, top = known[tree, block]
            rows += [(tree, pos, steps_up(ladder, i) + above, top) for i, pos in enumerate(part["pos"].tolist())]
        return pd.DataFrame(rows, columns=["tree", "pos", "steps", "top"])

    return run


def _manifest(bits: int, with_proofs: bool):
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        known = {(_name(t), int(p)): (list(s), sub, root) for t, p, s, sub, root in zip(*(outer[c] for c in ("tree", "pos", "steps", "top", "root")))}
        ids, rows = [], []
        for tree, block, part, ladder in _superblocks(leaves, bits):
            above, subroot, root = known[tree, block]
            ids.append(part["id"])
            for i, (leaf, altered) in enumerate(zip(part["hash"].tolist(), part["altered"].tolist())):
                steps = steps_up(ladder, i) + above
                found = folded(_name(altered) or leaf, steps)
                rows.append((leaf, subroot, root, steps if with_proofs else None, _hash("".join(s[1:] for s in steps)), found, found == root))
        out = pd.DataFrame(rows, columns=["leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])
        out.insert(0, "id", pd.concat(ids, ignore_index=True) if ids else pd.Series([], dtype=leaves["id"].dtype))
        return out

    return run


def _small(df: DataFrame) -> DataFrame:
    """A stored table as the side of a join: broadcast up to a number of rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, a row's place in its tree, and ``size``, the tree's number of rows.
    ``order`` tells all rows apart."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(width, "tree", *order).sortWithinPartitions("tree", *order)
    # the partition, and the place in it
    ranged = storage.stored(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("at", 33))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    runs = runs.select(
        F.col("tree").alias("t"), F.col("part").alias("p"), "least",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("size"),
    )
    runs = storage.stored(runs, "runs")
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))
    return ranged.join(_small(runs), same).withColumn("pos", F.expr("offset + at - least")).drop("t", "p", "least", "offset", "at", "part")


def _bundle(bundles: int, block: str) -> Column:
    return F.expr(f"pmod(xxhash64(tree, {block}), {bundles})").alias("bundle")


def _bundled(nodes: DataFrame, bundles: int, bits: int) -> DataFrame:
    return nodes.select(_bundle(bundles, f"shiftright(pos, {bits})"), "*")


def _reduced(nodes: DataFrame, bundles: int, bits: int) -> DataFrame:
    few = nodes.select("tree", "pos", "size", "hash")
    tops = _bundled(few, bundles, bits).groupBy("bundle").applyInPandas(_tops(bits), "tree string, pos bigint, size bigint, hash string")
    return storage.stored(tops, "tops")


def _n_bundles(nodes: DataFrame, bits: int) -> int:
    return -(-nodes.count() // (1 << bits)) or 1


def paths(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, steps, top) of stored ``nodes(tree, pos, size, hash)``: the way of
    every node to the top of its tree."""
    if not nodes.where("size > 1").take(1):
        return nodes.selectExpr("tree", "pos", "cast(array() as array<string>) as steps", "hash as top")
    bundles = _n_bundles(nodes, bits)
    outer = paths(_reduced(nodes, bundles, bits), bits).select(_bundle(bundles, "pos"), "*")
    both = _bundled(nodes, bundles, bits).groupBy("bundle").cogroup(outer.groupBy("bundle"))
    return storage.stored(both.applyInPandas(_paths(bits), PATH), "paths")


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", tree: str = "lang",
    altered: dict[str, str] | None = None, where: str = "false", bits: int = BITS, with_proofs: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: its key, leaf, subroot, root, proof (see ``steps_up``),
    proof_sha256 (digest of the siblings), folded_root and verified.

    For a trial of the proofs, rows that fulfil ``where`` are folded from a leaf whose
    fields are replaced by the SQL of ``altered``; all other nodes stay as they are."""
    text = lambda c: f"cast(`{c}` as string)"
    changed = [f"cast({altered[c]} as string)" if altered and c in altered else text(c) for c in fields]
    leaves = docs.selectExpr(
        f"`{key}` as id", f"{text(tree)} as tree", f"{digest([text(c) for c in fields])} as hash",
        f"case when {where} then {digest(changed)} end as altered",
    ).withColumn("row", F.monotonically_increasing_id())
    leaves = placed(storage.stored(leaves, "leaves"), ["id", "hash", "row"]).drop("row")
    bundles = _n_bundles(leaves, bits)
    outer = paths(_reduced(leaves, bundles, bits), bits)
    subroots = placed(storage.stored(outer.where("pos = 0").selectExpr("cast(null as string) as tree", "tree as name", "top as hash"), "subroots"), ["name"])
    subroots = storage.stored(subroots, "subroots")
    above = storage.stored(
        paths(subroots, bits).select("pos", F.col("steps").alias("rest"), F.col("top").alias("root"))
        .join(_small(subroots.select("name", "pos")), "pos").drop("pos"), "above",
    )
    outer = outer.join(_small(above), F.col("tree").eqNullSafe(F.col("name"))).select(
        _bundle(bundles, "pos"), "tree", "pos", F.concat("steps", "rest").alias("steps"), "top", "root"
    )
    kind = leaves.schema["id"].dataType.simpleString()
    both = _bundled(leaves, bundles, bits).groupBy("bundle").cogroup(outer.groupBy("bundle"))
    found = both.applyInPandas(_manifest(bits, with_proofs), (
        f"id {kind}, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    ))
    return found.withColumnRenamed("id", key)

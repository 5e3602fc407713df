"""Merkle manifests against a plain construction."""

import zlib
from hashlib import sha256

import pytest

from maskwright.llm import merkle

KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, pos string, id string, hash string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top of a list of nodes, and for every node its siblings with their sides."""
    at, steps, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        for i, a in enumerate(at):
            beside = a ^ 1
            steps[i].append(("R" if beside > a else "L", level[beside]) if beside < len(level) else None)
            at[i] = a // 2
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], steps


def plain(rows, altered=lambda row: row):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    out, subs = [], []
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append(climb([leaf(r) for r in trees[name]]))
    root, above = climb([top for top, _ in subs])
    for name, (sub, inside), rest in zip(names, subs, above):
        for row, steps in zip(trees[name], inside):
            steps, node = steps + rest, leaf(altered(row))
            for step in steps:
                node = h(node if step is None else step[1] + node if step[0] == "L" else node + step[1])
            proof = h("".join(s[1] for s in steps if s))
            out.append((row[0], leaf(row), sub, root, proof, node, node == root))
    return out


def one_more(row):
    chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
    return (*row[:3], row[3] + 1, row[4]) if chosen and row[3] is not None else row


def found(spark, rows, bits):
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], KIND)
    out = merkle.manifest(docs, altered={"n_chars": "n_chars + 1"}, where="crc32(cast(doc_id as string)) % 7 = 0", bits=bits)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof").collect()


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_trees_of_all_sizes(spark, bits):
    sizes = {"a": 1, "b": 2, "ä": 3, None: 5, "": 17, "de": 33}
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 37 % 101, f"s{i % 3}", name, i if i % 5 else None, "é🎉" * (i % 4) if i % 6 else None))
    got = found(spark, rows, bits)
    assert order(r[:7] for r in got) == order(plain(rows, one_more))
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_proofs_lead_from_the_leaf_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, f"text {i}") for i in range(40)]
    for r in found(spark, rows, 2):
        assert merkle.folded(r.leaf, r.proof) == r.root
        assert merkle.folded(h("another leaf"), r.proof) != r.root


def test_many_trees_of_one_leaf_and_one_large_tree(spark):
    rows = [(i, None, f"t{i}", 0, "x") for i in range(60)] + [(i, None, "large", 0, "x") for i in range(100)]
    assert order(r[:7] for r in found(spark, rows, 2)) == order(plain(rows, one_more))


def test_odd_rows(spark, odd_rows):
    """Nulls in every column, empty and long texts, ids that repeat, repeated rows."""
    rows = [(i, None if n % 3 else "s", None if n % 2 else "en", None if n % 4 else n, t) for n, (i, t) in enumerate(odd_rows)]
    assert order(r[:7] for r in found(spark, rows, 1)) == order(plain(rows, one_more))
    same = [(None, None, None, None, None)] * 9
    got = found(spark, same, 2)
    assert order(r[:7] for r in got) == order(plain(same)) and all(r.verified for r in got)


def test_one_leaf_and_an_empty_table(spark):
    one = found(spark, [(5, "s", "en", 1, "t")], 10)
    assert [tuple(r[:7]) for r in one] == plain([(5, "s", "en", 1, "t")], one_more) and one[0].root == one[0].leaf
    assert found(spark, [], 10) == []

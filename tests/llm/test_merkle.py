"""Merkle manifests: addresses, trees against a plain recursion, proofs, odd rows, SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlight.llm import merkle, queries
from tests.compare import connect, differences
from tests.conftest import TABLES
from tests.llm.conftest import ROWS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and of every leaf its siblings from below upwards."""
    proofs, level = ["" for _ in leaves], leaves
    owners = [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = range(0, len(level), 8)
        for r in runs:
            for k in range(r, min(r + 8, len(level))):
                others = "".join(level[r:k] + level[k + 1:r + 8])
                for i in owners[k]:
                    proofs[i] += others
        owners = [sum(owners[r:r + 8], []) for r in runs]
        level = [sha("".join(level[r:r + 8])) for r in runs]
    return level[0], proofs


def brute(rows):
    """Expected rows of (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    inner = {name: sorted(trees[name]) for name in names}
    done = {name: tree([x[2] for x in inner[name]]) for name in names}
    root, above = tree([done[name][0] for name in names])
    out = []
    for name, path in zip(names, above):
        for (*_, own, r), proof in zip(inner[name], done[name][1]):
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = r[4] and r[4].translate({ord(c): c.lower() for c in UPPER})
            same = not altered or now == r[4]
            out.append((r[0], own, done[name][0], root, sha(proof + path), same))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def verified(docs):
    rows = merkle.verify(merkle.manifest(docs, F.when(
        F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, UPPER.lower()))))
    out = rows.collect()
    for r in out:
        assert r["verified"] == (r["folded_root"] == r["root"])
    return ordered([(*r[:5], r["verified"]) for r in out])


@pytest.mark.parametrize("levels", range(1, 7))
def test_addresses_are_a_permutation_with_compact_subtrees(levels):
    places = [merkle.address(levels, d, np.arange(8 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.size(levels)))
    assert places[0].tolist() == [0]
    top = levels // 2
    if top:                                     # a bottom subtree is one contiguous stretch
        for k in (0, 8 ** top - 1):
            below = np.concatenate([p[k * 8 ** (d - top):(k + 1) * 8 ** (d - top)]
                                    for d, p in enumerate(places) if d >= top])
            assert np.ptp(below) + 1 == len(below) == merkle.size(levels - top)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 511, 513, 4096])
def test_blocks_equal_plain_trees(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    height = merkle.block_height(n, False)
    nodes = merkle.build_block(leaves, height)
    root, proofs = tree([x.hex() for x in leaves])
    levels = merkle.levels_of(nodes, height, n)
    assert nodes[:32].hex() == root and merkle._present(nodes, height) == n
    for i in {0, n // 2, n - 1}:
        path = merkle.siblings(levels, i)
        assert "".join(a + b for a, b in path) == proofs[i]
        assert merkle.fold(leaves[i].hex(), path) == root
        assert n == 1 or merkle.fold(leaves[i - 1].hex(), path) != root


def test_odd_rows(odd_docs, no_docs):
    rows = [(i, s, lang, len(t or ""), t) for i, t, lang, s in ROWS]
    assert verified(odd_docs) == ordered(brute(rows))
    assert merkle.verify(merkle.manifest(no_docs)).count() == 0


def test_many_rounds_many_trees_and_ties(spark, monkeypatch):
    """Small blocks make several rounds, of the trees and of the tree over them."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    merkle.addresses.cache_clear()
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(150)]), draw.choice("ab"), draw.choice([None, "en", "en", "en"]),
             draw.choice([None, 3]), draw.choice(["Same", "x", "", None])) for _ in range(700)]
    rows += [(i, "s", f"dirty-{i}-é" if i % 2 else "", 1, f"T{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    try:
        assert verified(docs.repartition(7)) == ordered(brute(rows))
    finally:
        merkle.addresses.cache_clear()


def test_a_forged_sibling_changes_the_root(spark):
    docs = spark.createDataFrame([(i, "a", "en", 1, f"t{i}") for i in range(40)],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    root = merkle.verify(merkle.manifest(docs)).first()
    other = merkle.verify(merkle.manifest(docs.where("doc_id <> 39"))).first()
    assert root["verified"] and other["verified"] and root["root"] != other["root"]


def test_query_equals_sql(spark):
    sql = queries.ORACLES["op13_merkle_manifest"]
    assert not differences(queries.op13_merkle_manifest(spark, TABLES), connect(TABLES), sql)

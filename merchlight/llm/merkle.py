"""A Merkle manifest of a table: one tree a language, one over the languages' roots.

Leaves are numbered within their tree over all tasks (sorted by ranges, then offset by
the counts of earlier tasks) and cut into aligned blocks of 8^4. A block holds all
nodes of its subtree in one binary in van Emde Boas order: the levels are split at
half height, the top half is stored first, then every bottom subtree, each laid out
by the same rule. ``address`` finds a node by arithmetic alone, which serves building
and the look-up of siblings alike; a node's place tells nothing of cache sizes, yet
any path crosses few of them. Roots of blocks are the leaves of the next round of
blocks, until every tree is one node. Places of nodes that do not exist stay zero.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from merchlight.llm.common import discard, put

#: Children of a node; levels of edges in a block, so that it has at most 8^4 leaves.
FAN, HEIGHT = 8, 4
BLOCK = FAN ** HEIGHT
#: Bits that ``monotonically_increasing_id`` leaves for the place within a task.
PLACE_BITS = 33
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCKS = "tree string, block long, n_blocks long, height int, nodes binary"
LEAVES = BLOCKS + ", doc_ids array<long>, altered array<binary>"
#: A path lists, level by level upwards, the siblings left and right of a node.
PATHS = "tree string, rank long, path array<struct<left:binary,right:binary>>"


# -- addresses ---------------------------------------------------------------------


def size(levels: int) -> int:
    """Nodes of a full tree of so many levels of nodes."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the ``index``-th nodes of a depth stand in a full tree of ``levels``."""
    place, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = FAN ** (depth - top)            # nodes of this depth in a bottom subtree
        levels -= top
        place += size(top) + index // below * size(levels)
        index = index % below
        depth -= top
    return place


@lru_cache(maxsize=HEIGHT + 1)
def addresses(height: int) -> list[np.ndarray]:
    """The addresses of every depth of a full block."""
    return [address(height + 1, d, np.arange(FAN ** d)) for d in range(height + 1)]


def block_height(leaves: int, more_blocks: bool) -> int:
    """A block among others is full height; a tree of its own ends at its root."""
    height = 0
    while FAN ** height < leaves:
        height += 1
    return HEIGHT if more_blocks else height


# -- the manifest ------------------------------------------------------------------


@dataclass
class Manifest:
    """Written tables: the blocks of every round, of the trees and of the top tree.

    ``rounds[0]`` holds leaves with their ids (and altered leaves), later rounds the
    roots of the blocks before. ``names`` has the trees' names, ranks and roots,
    ``roots`` the top tree's one root (or no row).
    """

    rounds: list[DataFrame]
    top: list[DataFrame]
    names: DataFrame
    roots: DataFrame


def digest(*parts: Column) -> Column:
    """sha256 of the concatenated texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def manifest(docs: DataFrame, altered_text: Column | None = None,
             fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The Merkle trees of a table, every input row a leaf.

    A tree is the rows of one ``lang``, null included, ascending by ``doc_id`` (null
    first; equal ids by their leaf, equal rows in any order). ``altered_text``, a column
    over ``docs``, gives the text that ``verify`` finds in place of ``text``; null
    where it is unaltered. Only the five fields count, other columns are
    ignored; empty texts are values, and an empty table has no root.
    """
    names = dict(zip(FIELDS, fields))
    found = {name: field(F.col(f"`{given}`")) for name, given in names.items()}
    altered = F.lit(None).cast("binary") if altered_text is None else F.when(
        altered_text.isNotNull(), digest(*{**found, "text": field(altered_text)}.values()))
    leaves = docs.select(
        F.col(f"`{names['doc_id']}`").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{names['lang']}`").cast("string")),
                   F.lit("")).alias("tree"),
        digest(*found.values()).alias("digest"), altered.alias("altered"),
        F.monotonically_increasing_id().alias("salt"))
    ranked = numbered(leaves, F.asc_nulls_first("doc_id"), F.col("digest"), F.col("salt"))
    rounds, subroots = _rounds(put(_built(ranked, LEAVES), "merkle-leaves"))
    discard(ranked)
    names = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"),
                                     "digest"), F.col("name"))
    top, roots = _rounds(put(_built(names, BLOCKS), "merkle-top"))
    return Manifest(rounds, top, names, roots)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 0 within each ``tree`` and the tree's ``total``.

    Sorted over ranges of the whole order, so that one tree, or one id, spreads over
    many tasks; a task's share of a tree is offset by the shares of the tasks before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = put(rows.repartitionByRange(parts, "tree", *order)
                 .sortWithinPartitions("tree", *order).drop("salt")
                 .withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    task = F.shiftright("_at", PLACE_BITS).alias("_task")
    tree = Window.partitionBy("tree")
    starts = placed.groupBy("tree", task).agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")).select(
        "tree", "_task", F.sum("_n").over(tree).alias("total"),
        (F.sum("_n").over(tree.orderBy("_task")) - F.col("_n") - F.col("_first")).alias("_shift"))
    out = placed.withColumn("_task", task).join(starts, ["tree", "_task"]).withColumn(
        "rank", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")
    out.staged_at = placed.staged_at
    return out


def _rounds(first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks over the roots of blocks until each tree is one block; and the trees' roots."""
    rounds, done = [first], []
    while True:
        roots = rounds[-1].select("tree", F.col("block").alias("rank"), "n_blocks",
                                  F.substring("nodes", 1, 32).alias("digest"))
        done.append(roots.where("n_blocks = 1").select("tree", "digest"))
        going = roots.where("n_blocks > 1").withColumnRenamed("n_blocks", "total")
        if going.isEmpty():
            return rounds, reduce(DataFrame.unionByName, done)
        rounds.append(put(_built(going, BLOCKS), "merkle-round"))


def _built(nodes: DataFrame, schema: str) -> DataFrame:
    """One row a block of (tree, rank, total, digest): its subtree, from the leaves up."""
    keep_leaves = "doc_ids" in schema

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        leaves = group.column("digest").to_pylist()
        blocks = -(-group.column("total")[0].as_py() // BLOCK)
        height = block_height(len(leaves), blocks > 1)
        row = {"tree": group.column("tree")[0].as_py(), "block": group.column("block")[0].as_py(),
               "n_blocks": blocks, "height": height, "nodes": build_block(leaves, height)}
        if keep_leaves:
            row |= {"doc_ids": group.column("doc_id").to_pylist(),
                    "altered": group.column("altered").to_pylist()}
        return pa.Table.from_pylist([row], ARROW_LEAVES if keep_leaves else ARROW_BLOCKS)

    return nodes.withColumn("block", F.expr(f"rank div {BLOCK}")) \
        .groupBy("tree", "block").applyInArrow(build, schema)


ARROW_BLOCKS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n_blocks", pa.int64()),
                          ("height", pa.int32()), ("nodes", pa.binary())])
ARROW_LEAVES = pa.schema([*ARROW_BLOCKS, ("doc_ids", pa.list_(pa.int64())),
                          ("altered", pa.list_(pa.binary()))])


def build_block(leaves: list[bytes], height: int) -> bytes:
    """The subtree over at most 8^height leaves, in van Emde Boas order."""
    nodes = np.zeros((size(height + 1), 32), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        raw = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
        nodes[addresses(height)[depth][:len(level)]] = raw
        shown = raw.tobytes().hex()
        level = [hashlib.sha256(shown[i:i + 64 * FAN].encode()).digest()
                 for i in range(0, len(shown), 64 * FAN)]
    return nodes.tobytes()


# -- siblings and verification -------------------------------------------------------


def levels_of(nodes: bytes, height: int, leaves: int) -> list[str]:
    """The existing nodes of every depth as joined hexadecimal text, leaves first."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    out = []
    for depth in range(height, -1, -1):
        out.append(table[addresses(height)[depth][:leaves]].tobytes().hex())
        leaves = -(-leaves // FAN)
    return out


def siblings(levels: list[str], index: int) -> list[tuple[str, str]]:
    """The other digests of each run on the way up from a leaf, left and right of it."""
    out = []
    for level in levels[:-1]:
        run = index // FAN * 64 * FAN
        own = 64 * index
        out.append((level[run:own], level[own + 64:run + 64 * FAN]))
        index //= FAN
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _leaf_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``PATHS`` of all block roots of round 0, from ``above``: the paths of tree roots."""
    paths = None
    for blocks in reversed(rounds[1:]):
        paths = _with_path(blocks, paths, above).mapInArrow(_climb, PATHS)
    return _with_path(rounds[0], paths, above)


def _with_path(blocks: DataFrame, paths: DataFrame | None, above: DataFrame) -> DataFrame:
    """Blocks with their root's path: of a whole tree from above, else of the next round."""
    whole = blocks.where("n_blocks = 1").join(above.drop("rank"), "tree")
    if paths is None:
        return whole
    part = blocks.where("n_blocks > 1").join(
        paths.withColumnRenamed("rank", "block"), ["tree", "block"])
    return whole.unionByName(part, allowMissingColumns=True)


def _present(nodes: bytes, height: int) -> int:
    """How many leaves a block holds: places that do not exist are zero."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    return int(table[addresses(height)[height]].any(axis=1).sum())


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every leaf of the blocks."""
    pair = pa.struct([("left", pa.binary()), ("right", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in ("tree", "block", "height", "nodes",
                                                           "path")}
            n = _present(row["nodes"], row["height"])
            levels = levels_of(row["nodes"], row["height"], n)
            paths = [[{"left": bytes.fromhex(a), "right": bytes.fromhex(b)}
                      for a, b in siblings(levels, k)] + row["path"] for k in range(n)]
            yield pa.record_batch([pa.array([row["tree"]] * n, pa.string()),
                                   pa.array(np.arange(n) + row["block"] * BLOCK, pa.int64()),
                                   pa.array(paths, pa.list_(pair))],
                                  names=["tree", "rank", "path"])


def verify(m: Manifest) -> DataFrame:
    """Every leaf's proof, and the root folded from its altered (else own) leaf.

    Columns: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, all
    digests in hexadecimal. The proof is the siblings from the leaf to the root, left
    to right, level by level; an only leaf has none.
    """
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    end = m.roots.select("tree", F.lit(0).cast("long").alias("rank"), nothing.alias("path"))
    top = _leaf_paths(m.top, end).mapInArrow(_climb, PATHS).select("rank", "path")
    above = top.join(m.names, "rank").select(
        F.col("name").alias("tree"), "rank", "path", F.col("digest").alias("subroot"),
        m.roots.select("digest").scalar().alias("root"))
    blocks = _leaf_paths(m.rounds, above.drop("subroot", "root")) \
        .join(above.select("tree", "subroot", "root"), "tree")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _folded(batch.slice(i, 1).to_pylist()[0])

    return blocks.select("height", "nodes", "doc_ids", "altered", "path", "subroot", "root") \
        .mapInArrow(folded, "doc_id long, leaf string, subroot string, root string, "
                            "proof_sha256 string, folded_root string, verified boolean")


def _folded(row: dict) -> pa.RecordBatch:
    n = len(row["doc_ids"])
    levels = levels_of(row["nodes"], row["height"], n)
    upper = [(x["left"].hex(), x["right"].hex()) for x in row["path"]]
    rest = "".join(a + b for a, b in upper)
    subroot, root = row["subroot"].hex(), row["root"].hex()
    leaves, proofs, roots = [], [], []
    for k in range(n):
        own = siblings(levels, k)
        leaf = levels[0][64 * k:64 * k + 64]
        found = row["altered"][k]
        leaves.append(leaf)
        proofs.append(hashlib.sha256(("".join(a + b for a, b in own) + rest).encode())
                      .hexdigest())
        roots.append(fold(leaf if found is None else found.hex(), own + upper))
    return pa.record_batch(
        [pa.array(row["doc_ids"], pa.int64()), pa.array(leaves), pa.array([subroot] * n),
         pa.array([root] * n), pa.array(proofs), pa.array(roots),
         pa.array([x == root for x in roots])],
        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

"""Approximate nearest neighbours by cosine, with a hierarchical k-means tree.

The tree is fitted on a bounded sample: ``SAMPLE`` unit vectors, split by k-means
into ``BRANCH`` children down to leaves. Every vector of the table goes to a leaf by
descending the tree. A query visits leaves best bin first: a priority queue holds the
branches not taken, nearest centre first. How many leaves are visited is calibrated:
it widens until ``RECALL`` of the true neighbours of ``PROBES`` queries, found by
brute force over all rows, lie in visited leaves. Leaf and visitors meet in one
shuffle; a leaf with many vectors is cut into blocks of bounded size, each with all
visitors, and a task scores one block at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from merchlight.llm.common import put

SAMPLE, BRANCH, LEAF = 20_000, 8, 64
PROBES, RECALL = 200, 0.97
#: Vectors in one block of a leaf, on average; queries scored against it at a time.
BLOCK, VISITORS = 2048, 512


@dataclass
class Node:
    centre: np.ndarray
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that take part.

    Left out: null ids and vectors, empty ones, null or non-finite components, zeros.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(
        F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", sample: int = SAMPLE, branch: int = BRANCH,
            leaf: int = LEAF, probes: int = PROBES, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found rows.

    Candidates are all rows of ``vectors`` but those with the query's id; nearest
    means largest cosine, ties go to the smaller id. Vectors that are null, empty, zero
    or hold a null or non-finite component take no part on either side; neither do
    vectors of another length than the most common one of the sample. Repeated rows
    are one vector (of several under one id, the largest). Other columns are ignored;
    without vectors or queries the result is empty.
    """
    rows = put(usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.max("v").alias("v")),
               "vectors")
    asked = put(usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.max("v").alias("v")),
                "queries")
    taken = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    width = int(np.bincount([len(v) for v in taken]).argmax()) if taken else 0
    tree = grow(np.array([v for v in taken if len(v) == width]).reshape(-1, max(width, 1)),
                branch, leaf)
    rows = put(_with_leaf(rows.where(F.size("v") == width), tree), "leaves")
    asked = asked.where(F.size("v") == width)
    visits = calibrated(rows, asked, tree, k, probes, recall)
    return searched(rows, asked, tree, k, visits)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grow(vectors: np.ndarray, branch: int, leaf: int) -> list[Node]:
    """The tree's nodes, the root first; leaves are numbered from 0."""
    if not len(vectors):
        return []
    x = unit(vectors)
    root = Node(x.mean(axis=0))
    nodes, leaves, queue = [root], 0, [(root, x)]
    while queue:
        node, own = queue.pop()
        groups = _kmeans(own, branch) if len(own) > leaf else [own]
        if len(groups) < 2:
            node.leaf = leaves
            leaves += 1
            continue
        for group in groups:
            child = Node(group.mean(axis=0))
            node.children.append(child)
            nodes.append(child)
            queue.append((child, group))
    return nodes


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> list[np.ndarray]:
    centres = np.unique(x, axis=0)
    if len(centres) < 2:
        return [x]
    pick = np.linspace(0, len(centres) - 1, min(k, len(centres))).astype(int)
    centres = centres[pick]
    for _ in range(rounds):
        to = (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        centres = np.array([x[to == j].mean(axis=0) if (to == j).any() else centres[j]
                            for j in range(len(centres))])
    return [x[to == j] for j in range(len(centres)) if (to == j).any()]


def leaf_of(tree: list[Node], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), -1, np.int32)
    todo = [(tree[0], np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.leaf >= 0:
            out[rows] = node.leaf
            continue
        centres = np.array([c.centre for c in node.children])
        to = (x[rows] @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        for j, child in enumerate(node.children):
            if len(own := rows[to == j]):
                todo.append((child, own))
    return out


def best_bins(tree: list[Node], x: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` leaves of a unit vector, best bin first."""
    out, queue = [], [(0.0, 0, tree[0])]
    made = 0
    while queue and len(out) < visits:
        _, _, node = heapq.heappop(queue)
        while node.leaf < 0:
            away = [float(((c.centre - x) ** 2).sum()) for c in node.children]
            best = int(np.argmin(away))
            for j, child in enumerate(node.children):
                if j != best:
                    made += 1
                    heapq.heappush(queue, (away[j], made, child))
            node = node.children[best]
        out.append(node.leaf)
    return out


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _with_leaf(rows: DataFrame, tree: list[Node]) -> DataFrame:
    def descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = leaf_of(tree, unit(_matrix(batch.column(1))))
                yield pa.record_batch([*batch.columns, pa.array(leaf)],
                                      names=["vec_id", "v", "leaf"])

    return rows.mapInArrow(descended, "vec_id long, v array<double>, leaf int")


def top(ids: np.ndarray, x: np.ndarray, query: np.ndarray, own: int, k: int,
        rough: np.ndarray) -> list[tuple[int, float]]:
    """The k nearest of the rows by exact cosine; ``rough`` are cosines of unit vectors."""
    rough = np.where(ids == own, -np.inf, rough)
    few = min(k, len(rough)) - 1
    near = np.flatnonzero(rough >= np.partition(rough, -few - 1)[-few - 1] - 1e-9)
    near = near[ids[near] != own]
    if not len(near):
        return []
    score = cosine(x[near], query)
    order = np.lexsort((ids[near], -score))[:k]
    return [(int(ids[near[i]]), float(score[i])) for i in order]


def cosine(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    a, b = x / np.abs(x).max(axis=1, keepdims=True), query / np.abs(query).max()
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum())


def calibrated(rows: DataFrame, asked: DataFrame, tree: list[Node], k: int, probes: int,
               recall: float) -> int:
    """Leaves to visit, so that enough true neighbours of some queries are met."""
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).collect()
    if not sample:
        return 1
    ids = [r["vec_id"] for r in sample]
    probe = np.array([r["v"] for r in sample])
    goal = unit(probe)

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column(1)), np.asarray(batch.column(0))
                leaf, rough = np.asarray(batch.column(2)), goal @ unit(x).T
                place = {int(v): i for i, v in enumerate(own)}
                found = [(q, v, s, int(leaf[place[v]])) for q in range(len(ids))
                         for v, s in top(own, x, probe[q], ids[q], k, rough[q])]
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(
                        zip(*found), (pa.int32(), pa.int64(), pa.float64(), pa.int32()))],
                        names=["q", "vec_id", "score", "leaf"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = rows.mapInArrow(best_of_task, "q int, vec_id long, score double, leaf int") \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect()
    needed = []
    bins = [{b: n for n, b in enumerate(best_bins(tree, g, len(tree)))} for g in goal]
    for row in best:
        needed.append(bins[row["q"]][row["leaf"]] + 1)
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def searched(rows: DataFrame, asked: DataFrame, tree: list[Node], k: int,
             visits: int) -> DataFrame:
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = put(sizes, "sizes")

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            goal = unit(_matrix(batch.column(1)))
            bins = [best_bins(tree, g, visits) for g in goal]
            at = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            yield pa.record_batch([batch.column(0).take(pa.array(at)),
                                   batch.column(1).take(pa.array(at)),
                                   pa.array(np.concatenate(bins), pa.int32())],
                                  names=["vec_id", "v", "leaf"])

    visitors = asked.mapInArrow(visiting, "vec_id long, v array<double>, leaf int") \
        .join(sizes, "leaf").withColumn("block", F.explode(F.sequence(
            F.lit(0), F.col("blocks") - 1))).select("leaf", "block", "vec_id", "v")
    members = rows.join(sizes, "leaf").select("leaf", F.pmod(
        F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v")

    def scored(key, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(other):
            ids, x = own["vec_id"].to_numpy(), np.array(own["v"].tolist())
            ready = unit(x)
            for lo in range(0, len(other), VISITORS):
                part = other.iloc[lo:lo + VISITORS]
                goal = np.array(part["v"].tolist())
                rough = unit(goal) @ ready.T
                found += [(q, v, s) for i, q in enumerate(part["vec_id"].tolist())
                          for v, s in top(ids, x, goal[i], q, k, rough[i])]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    parts = members.groupBy("leaf", "block").cogroup(visitors.groupBy("leaf", "block")) \
        .applyInPandas(scored, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")

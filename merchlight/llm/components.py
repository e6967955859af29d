"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchlight.llm.common import discard, put


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``.

    The component is its smallest node. Each round points every node's larger
    neighbours at its smallest neighbour, then every node's smaller neighbours, and
    ends when nothing changes; the number of rounds grows with the logarithm of the
    longest path. A node with very many edges is one row per task in the minimum,
    and the minima are written before the join, so that the join's two sides are
    plain shuffles whose large keys the adaptive planner splits. Loops and repeated
    edges are harmless; an empty table gives an empty table. Edges with a null end
    are ignored.
    """
    pairs = put(_downward(edges.where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    before = None
    while (now := _fingerprint(pairs)) != before:
        before = now
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _contract(both, "v > u")
        small = _contract(large, None)
        discard(pairs, large)
        pairs = small
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _contract(pairs: DataFrame, keep: str | None) -> DataFrame:
    """Link the neighbours of each node u (and, without ``keep``, u) to its minimum."""
    low = put(pairs.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("m")), "minima")
    linked = pairs.join(low, "u")
    out = linked.where(keep) if keep else linked
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not keep:
        out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    done = put(_downward(out), "pairs")
    discard(low)
    return done


def _fingerprint(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

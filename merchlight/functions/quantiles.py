"""Exact quantiles without gathering all values in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, ignoring nulls.

    ``percentile`` merges every distinct value into one aggregation buffer, which
    does not hold for billions of values. Here one pass of the bounded
    ``percentile_approx`` sketch brackets each wanted rank, a second pass counts
    what lies below the bracket, and only the distinct values inside it (about
    ``4 / accuracy`` of the rows, repeated values counted once) are ranked. If a
    rank is ever outside its bracket, the bracket is widened to all values, so
    the result does not depend on the sketch. Hand in a stored DataFrame: it is
    read twice.
    """
    slots = [(c, p) for c in columns for p in probs]
    margin = 2.0 / accuracy
    aggs = []
    for c in columns:
        value = F.col(c).cast("double")
        edges = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
        aggs += [F.count(value).alias(f"n_{c}"),
                 F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}"),
                 F.percentile_approx(value, edges, accuracy).alias(f"edges_{c}")]
    head = df.agg(*aggs).first()

    targets = {}
    for i, (c, p) in enumerate(slots):
        n = head[f"n_{c}"]
        if n:
            at = (n - 1) * p
            pos = list(probs).index(p)
            low, high = head[f"edges_{c}"][2 * pos: 2 * pos + 2]
            targets[i] = (c, at, low, high)

    found = _rank(df, targets)
    missed = {i: (c, at, head[f"min_{c}"], head[f"max_{c}"])
              for i, (c, at, _, _) in targets.items() if i not in found}
    if missed:
        found.update(_rank(df, missed))

    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for i, (c, _) in enumerate(slots):
        out[c].append(found.get(i))
    return out


def _rank(df: DataFrame, targets: dict[int, tuple]) -> dict[int, float]:
    """Value at each target position, for targets whose bracket holds it."""
    if not targets:
        return {}
    below = df.agg(*[F.count_if(F.col(c).cast("double") < F.lit(low)).alias(f"b{i}")
                     for i, (c, _, low, _) in targets.items()]).first()
    near = reduce(Column.__or__, [F.col(c).cast("double").between(low, high)
                                  for c, _, low, high in targets.values()])
    inside = df.filter(near).select(F.explode(F.array_compact(F.array(*[
        F.when(F.col(c).cast("double").between(low, high),
               F.struct(F.lit(i).alias("slot"), F.col(c).cast("double").alias("value")))
        for i, (c, _, low, high) in targets.items()]))).alias("v")).select("v.*")
    counted = inside.groupBy("slot", "value").count()
    running = W.partitionBy("slot").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("count").over(running))

    wanted = F.lit(False)
    for i, (_, at, _, _) in targets.items():
        for rank in {math.floor(at), math.ceil(at)}:
            local = rank - below[f"b{i}"]
            wanted = wanted | ((F.col("slot") == i) & (F.col("upto") > local)
                               & (F.col("upto") - F.col("count") <= local))
    hits = ranked.filter(wanted).collect()   # at most two rows per target

    found = {}
    for i, (_, at, _, _) in targets.items():
        rows = [r for r in hits if r["slot"] == i]
        ends = []
        for rank in (math.floor(at), math.ceil(at)):
            local = rank - below[f"b{i}"]
            ends += [r["value"] for r in rows
                     if r["upto"] - r["count"] <= local < r["upto"]]
        if len(ends) == 2:
            low, high = ends
            found[i] = low + (high - low) * (at - math.floor(at))
    return found

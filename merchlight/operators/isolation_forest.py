"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark stages.

Sampling, tree building (one task group per tree) and scoring run in Spark; only
the finished trees, whose size is fixed by the number of trees and the sample
size, pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from merchlight.functions.quantiles import exact_quantiles
from merchlight.session import spread, stage

#: Nodes of a forest, which the driver gathers and every worker holds (16 bytes each).
MOST_NODES = 4_000_000
NODE_SCHEMA = "tree int, node int, feature int, split double, size int"
HASH_RANGE = 2_147_483_647


def isolation_forest(df: DataFrame, features: Sequence[str], id_cols: Sequence[str],
                     contamination: float = 0.05, trees: int = 100, sample: int = 256,
                     seed: int = 42) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher is stranger) and ``is_anomaly``.

    ``id_cols`` name each row: samples are drawn by their hash, so the outcome
    does not depend on partitioning. Rows scoring strictly above the exact
    ``1 - contamination`` quantile are flagged. Rows with a null feature get a
    null score.
    """
    stored = stage(df, "forest-input")
    complete = stored.dropna(subset=list(features))
    total = complete.count()
    if total < 2:
        return stored.withColumns({"score": F.lit(None).cast("double"),
                                   "is_anomaly": F.lit(False)})
    forest = _grow(complete, features, id_cols, total, trees, sample, seed)
    score = _scorer(stored, forest, min(sample, total))
    numbers = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    known = F.lit(True)
    for c in features:
        known = known & F.col(c).isNotNull()
    scored = stage(stored.withColumn("score", F.when(known, score(numbers))),
                   "forest-score")
    cut = exact_quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return scored.withColumn(
        "is_anomaly", F.coalesce(F.col("score") > F.lit(cut), F.lit(False)))


def _grow(rows: DataFrame, features, id_cols, total, trees, sample, seed) -> dict:
    """Sample, build one tree per group, and return the nodes as arrays.

    Every tree draws from all rows: a row stays in those trees for which a hash of
    seed, tree and id is below four times the sample's share, and of these each tree
    takes the ``sample`` lowest hashes. A tree sees fewer only if there are fewer rows.
    """
    if trees * 4 * sample > MOST_NODES:         # a tree has at most 4 * sample places
        raise ValueError(f"trees * sample must stay below {MOST_NODES // 4}")
    keep = min(HASH_RANGE, HASH_RANGE * 4 * sample // total + 1)
    numbers = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    row = F.xxhash64(F.lit(seed), *[F.col(c) for c in id_cols])
    place = F.xxhash64("tree", "_row")
    drawn = rows.select(*numbers, row.alias("_row")) \
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))) \
        .withColumn("_hash", F.pmod(place, F.lit(HASH_RANGE))) \
        .filter(F.col("_hash") < keep)
    draw = W.partitionBy("tree").orderBy("_hash", "_row")
    drawn = drawn.withColumn("draw", F.row_number().over(draw)) \
                 .filter(F.col("draw") <= sample).drop("_hash", "_row")

    size = min(sample, total)
    height = max(1, math.ceil(math.log2(size)))
    columns = [f"x{i}" for i in range(len(features))]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = pdf.sort_values("draw")[columns].to_numpy(dtype=float)
        return _build_tree(tree, values, height, np.random.default_rng([seed, tree]))

    nodes = spread(drawn, "tree").groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    width = 2 ** (height + 1)
    shape = (trees, width)
    forest = {"height": height, "feature": np.full(shape, -1, dtype=np.int32),
              "split": np.zeros(shape), "size": np.ones(shape, dtype=np.int32)}
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    for name in ("feature", "split", "size"):
        forest[name][at] = nodes[name].to_numpy()
    return forest


def _build_tree(tree: int, values: np.ndarray, height: int,
                rng: np.random.Generator) -> pd.DataFrame:
    """Random splits down to the height limit; node n has children 2n and 2n + 1."""
    nodes, todo = [], [(1, 0, np.arange(len(values)))]
    while todo:
        node, depth, rows = todo.pop()
        part = values[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
        if depth == height or len(rows) < 2 or not len(spread):
            nodes.append((tree, node, -1, 0.0, len(rows)))
            continue
        feature = int(rng.choice(spread))
        column = part[:, feature]
        split = rng.uniform(column.min(), column.max())
        right = column > split
        nodes.append((tree, node, feature, split, len(rows)))
        todo.append((2 * node + 1, depth + 1, rows[right]))
        todo.append((2 * node, depth + 1, rows[~right]))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "size"])


def _unbuilt_depth(size: np.ndarray | float) -> np.ndarray:
    """Mean path length of a random tree over ``size`` rows."""
    size = np.asarray(size, dtype=float)
    big = np.maximum(size, 3.0)
    long = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(size <= 1, 0.0, np.where(size <= 2, 1.0, long))


def forest_scores(values: np.ndarray, forest: dict, size: int) -> np.ndarray:
    """Score of each row: 2 to the minus (mean path length / expected length)."""
    n, trees = len(values), len(forest["feature"])
    depth = np.zeros((n, trees))
    node = np.ones((n, trees), dtype=np.int64)
    which = np.arange(trees)
    for _ in range(forest["height"]):
        feature = forest["feature"][which, node]
        inner = feature >= 0
        x = np.take_along_axis(values, np.maximum(feature, 0), axis=1)
        step = 2 * node + (x > forest["split"][which, node])
        node = np.where(inner, step, node)
        depth += inner
    depth += _unbuilt_depth(forest["size"][which, node])
    return 2.0 ** (-depth.mean(axis=1) / max(float(_unbuilt_depth(size)), 1e-12))


def _scorer(df: DataFrame, forest: dict, size: int):
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            known = ~np.isnan(values).any(axis=1)
            out = np.full(len(values), np.nan)
            out[known] = forest_scores(values[known], shared.value, size)
            yield pd.Series(out)

    return score


def isolation_forest_by_key(daily: DataFrame, features: Sequence[str],
                            keys: Sequence[str], order: str = "date",
                            contamination: float = 0.05, trees: int = 100,
                            sample: int = 256, seed: int = 42) -> DataFrame:
    """One forest per day-grain series (a region, a product).

    A group is one series and holds at most one row per day, so it is fitted and
    scored in one go; series run side by side.
    """
    columns = list(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        values = pdf[columns].to_numpy(dtype=float)
        size = min(sample, len(values))
        if size < 2:
            return pdf.assign(score=np.nan, is_anomaly=False)
        height = max(1, math.ceil(math.log2(size)))
        shape = (trees, 2 ** (height + 1))
        forest = {"height": height, "feature": np.full(shape, -1, dtype=np.int32),
                  "split": np.zeros(shape), "size": np.ones(shape, dtype=np.int32)}
        for tree in range(trees):
            rng = np.random.default_rng([seed, tree])
            rows = rng.choice(len(values), size, replace=False)
            nodes = _build_tree(tree, values[rows], height, rng)
            for name in ("feature", "split", "size"):
                forest[name][tree, nodes["node"].to_numpy()] = nodes[name].to_numpy()
        scores = forest_scores(values, forest, size)
        cut = np.quantile(scores, 1 - contamination)
        return pdf.assign(score=scores, is_anomaly=scores > cut)

    typed = daily.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in columns])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in typed.schema]
    schema = ", ".join([*fields, "score double", "is_anomaly boolean"])
    complete = spread(typed.dropna(subset=columns), *keys)
    return complete.groupBy(*keys).applyInPandas(fit, schema)

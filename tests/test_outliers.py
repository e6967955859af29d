import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlight.operators import anomaly
from merchlight.operators.isolation_forest import (
    _build_tree, _unbuilt_depth, forest_scores, isolation_forest, isolation_forest_by_key)
from tests.conftest import day


def wave(n=200):
    return [100 + (i * 7919) % 41 for i in range(n)]


def test_zscores_of_a_constant_series(series):
    assert anomaly.zscore_anomalies(series([5] * 10), "total_sales").count() == 0


def test_zscore_severity_and_recent(series):
    daily = series(wave(60) + [100_000] + wave(3))
    got = anomaly.zscore_anomalies(daily, "total_sales", z=3).collect()
    assert len(got) == 1 and got[0].severity == "critical"
    values = np.array(wave(60) + [100_000] + wave(3), dtype=float)
    assert got[0].z_score == pytest.approx((100_000 - values.mean()) / values.std())
    scored = anomaly.zscores(daily, "total_sales")
    assert anomaly.recent_anomalies(scored, 4).count() == 1
    assert anomaly.recent_anomalies(scored, 3).count() == 0


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("x", 1)], "alert string, days int")
    b = spark.createDataFrame([("y", 2.0)], "alert string, actual double")
    got = anomaly.unified_alerts(a, b).orderBy("alert").collect()
    assert [(r.alert, r.days, r.actual) for r in got] == [("x", 1, None), ("y", None, 2.0)]


def test_forest_of_unbounded_size_is_refused(series):
    with pytest.raises(ValueError, match="trees"):
        isolation_forest(series(wave()), ["total_sales"], ["date"], trees=20_000, sample=256)


def test_forest_flags_and_repeats(series):
    daily = series(wave() + [5000])
    first = isolation_forest(daily, ["total_sales"], ["date"])
    flagged = {r.date for r in first.filter("is_anomaly").collect()}
    assert day(200) in flagged and 1 <= len(flagged) <= 11
    again = isolation_forest(daily.repartition(7).orderBy(F.desc("total_sales")),
                             ["total_sales"], ["date"])
    assert {r.date for r in again.filter("is_anomaly").collect()} == flagged
    rows = first.orderBy("total_sales").collect()
    scores = [r.score for r in rows]
    middle = float(np.median(scores))
    assert scores[0] > middle and scores[-1] > middle and scores[-1] == max(scores)
    assert all(0 < s < 1 for s in scores)


def test_forest_on_nulls_and_few_rows(series):
    got = isolation_forest(series([1, None, 2, 3]), ["total_sales"], ["date"]).collect()
    assert [r.score is None for r in sorted(got, key=lambda r: r.date)] == \
        [False, True, False, False]
    assert isolation_forest(series([1]), ["total_sales"], ["date"]).first().score is None


def test_forest_samples_from_many_rows(spark):
    df = spark.range(40_000).select("id", ((F.col("id") * 7919) % 1000).alias("x"))
    df = df.withColumn("x", F.when(F.col("id") == 123, 10 ** 6).otherwise(F.col("x")))
    scored = isolation_forest(df, ["x"], ["id"], contamination=0.1, trees=30, sample=64)
    assert scored.count() == 40_000
    flagged = scored.filter("is_anomaly")
    assert flagged.filter("id = 123").count() == 1 and flagged.count() <= 4000
    # trees that did not draw the extreme row see it like the largest one they drew
    largest = scored.filter("x = 999").agg(F.max("score")).first()[0]
    assert scored.filter("id = 123").first()["score"] >= largest - 0.01


def test_tree_walk_by_brute_force():
    """Scores from the node arrays equal a recursive walk over the same nodes."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(40, 2))
    height, trees = 6, 5
    shape = (trees, 2 ** (height + 1))
    forest = {"height": height, "feature": np.full(shape, -1), "split": np.zeros(shape),
              "size": np.ones(shape, dtype=int)}
    by_tree = []
    for t in range(trees):
        nodes = _build_tree(t, values, height, np.random.default_rng(t))
        by_tree.append({n.node: n for n in nodes.itertuples()})
        for n in nodes.itertuples():
            forest["feature"][t, n.node] = n.feature
            forest["split"][t, n.node] = n.split
            forest["size"][t, n.node] = n.size

    def depth(nodes, x, at=1):
        n = nodes[at]
        if n.feature < 0:
            return float(_unbuilt_depth(n.size))
        return 1 + depth(nodes, x, 2 * at + int(x[n.feature] > n.split))

    for nodes in by_tree:       # leaves hold every row once
        assert sum(n.size for n in nodes.values() if n.feature < 0) == 40
    want = [2 ** (-np.mean([depth(nodes, x) for nodes in by_tree])
                  / float(_unbuilt_depth(40))) for x in values]
    assert forest_scores(values, forest, 40) == pytest.approx(want)


def test_forest_per_key(spark):
    rows = [(k, day(i), float(v)) for k in ("a", "b")
            for i, v in enumerate(wave(100) + ([9000] if k == "a" else [-9000]))]
    daily = spark.createDataFrame(rows, "shop string, date date, total_sales double")
    got = isolation_forest_by_key(daily, ["total_sales"], ["shop"]).filter("is_anomaly")
    hits = {(r.shop, r.date) for r in got.collect()}
    assert {("a", day(100)), ("b", day(100))} <= hits and len(hits) <= 12


def test_revenue_anomalies_label(spark):
    rows = [(day(i), float(v), 10 + i % 3) for i, v in enumerate(wave(120) + [9000, 1, 110])]
    daily = spark.createDataFrame(rows, "date date, revenue double, orders int")
    got = {r.date: r.kind for r in anomaly.revenue_anomalies(daily).collect()}
    assert got[day(120)] == "spike" and got[day(121)] == "drop"


def test_trees_draw_from_all_rows(spark, monkeypatch):
    from merchlight.operators import isolation_forest as forest
    seen = []
    monkeypatch.setattr(forest, "spread", lambda df, *k: seen.append(df) or df)
    rows = spark.range(50_000).withColumn("x", F.col("id").cast("double"))
    forest._grow(rows, ["x"], ["id"], 50_000, 30, 256, 1)
    counts = seen[0].agg(F.count("*"), F.count_distinct("x0")).first()
    assert counts[0] == 30 * 256 and counts[1] > 6500

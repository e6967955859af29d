"""Stock under a forecast, and forecasts of past days, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from merchlight.operators import forecast, inventory
from tests.conftest import day

POSITION = "product_id int, quantity_on_hand long, daily_demand double"
AHEAD = "product_id int, ds date, yhat double"
COMING = "product_id int, ds date, quantity long"


def brute(stock, days, coming, safety, lead):
    """Day by day: arrivals, sales, what is missed; then the plan."""
    start, rows = max(stock or 0, 0), []
    level = start
    for d, y in days:
        demand = max(y or 0.0, 0.0)
        have = level + coming.get(d, 0)
        level = max(have - demand, 0.0)
        rows.append((d, demand, coming.get(d, 0), level, max(demand - have, 0.0)))
    total = sum(r[1] for r in rows)
    arrivals = sum(r[2] for r in rows)
    need = total + total / len(rows) * safety - arrivals - (stock or 0) if rows else 0
    out = next((r[0] for r in rows if r[4] > 1e-6), None)
    return rows, (arrivals, total, sum(r[4] for r in rows), min((r[3] for r in rows), default=start),
                  out, out and day((out - day(0)).days - lead), max(0, math.ceil(round(need, 6))))


def test_projection_and_plan_equal_brute_force(spark):
    draw = random.Random(8)
    position, ahead, coming = [], [], []
    for p in range(40):
        position.append((p, draw.choice([None, 0, 3, 40, 200, -5]), 1.0))
        if p % 9:
            ahead += [(p, day(i), draw.choice([0.0, 1.5, 7.25, None, -2.0, draw.uniform(0, 9)]))
                      for i in range(25)]
        coming += [(p, day(draw.randint(-3, 30)), draw.randint(1, 60)) for _ in range(draw.randint(0, 3))]
    stock = spark.createDataFrame(position, POSITION)
    days = spark.createDataFrame(ahead, AHEAD).repartition(5)
    orders = spark.createDataFrame(coming, COMING)
    got, plan = {}, {}
    for r in inventory.project_stock(stock, days, orders).orderBy("ds").collect():
        got.setdefault(r["product_id"], []).append(tuple(r)[1:])
    for r in inventory.restock_plan(stock, days, orders, 10, 5).collect():
        plan[r["product_id"]] = tuple(r)[2:]
    for p, on_hand, _ in position:
        due = {}
        for q, d, n in coming:
            if q == p:
                due[d] = due.get(d, 0) + n
        rows, want = brute(on_hand, [(d, y) for q, d, y in ahead if q == p], due, 10, 5)
        assert len(got.get(p, [])) == len(rows)
        for a, b in zip(got.get(p, []), rows):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)
        arrivals, total, lost, lowest, out, by, order = plan[p][0], *plan[p][1:]
        assert (arrivals, out, by, order) == (want[0], want[4], want[5], want[6])
        assert (total, lost, lowest) == pytest.approx((want[1], want[2], want[3]), abs=1e-9)


def test_flat_forecast_orders_the_same_as_the_rate(spark):
    rows = [(p, 17 * p % 60, p * 0.3) for p in range(50)]
    position = spark.createDataFrame(rows, POSITION)
    ahead = position.select("product_id", F.explode(F.sequence(
        F.lit(day(1)), F.lit(day(30)))).alias("ds"), F.col("daily_demand").alias("yhat"))
    rate = {r["product_id"]: r["restock_quantity"] for r in inventory.inventory_needs(position).collect()}
    plan = {r["product_id"]: r["restock_quantity"] for r in inventory.restock_plan(position, ahead).collect()}
    assert plan == rate


def daily(spark, n=120, gaps=()):
    rows = [(k, day(i), float(10 + i % 7 + (k == "b") * i)) for k in "ab" for i in range(n) if i not in gaps]
    return spark.createDataFrame(rows, "k string, date date, v double")


@pytest.mark.parametrize("method", ["moving_average", "holt_winters", "seasonal"])
def test_an_origin_sees_no_later_day(spark, method):
    table = daily(spark)
    got = forecast.rolling_origins(table, "v", method, ["k"], horizon=10, origins=3, step=20)
    by = {}
    for r in got.collect():
        by.setdefault((r["k"], r["origin"]), {})[r["ds"]] = (r["yhat"], r["step"])
    assert sorted({o for _, o in by}) == [day(69), day(89), day(109)]
    one = {"moving_average": forecast.moving_average_forecast, "holt_winters": forecast.holt_winters,
           "seasonal": forecast.seasonal_forecast}[method]
    for origin in (69, 109):
        alone = one(table.where((F.col("k") == "b") & (F.col("date") <= F.lit(day(origin)))), "v", 10)
        for r in alone.collect():
            yhat, step = by["b", day(origin)][r["ds"]]
            assert yhat == pytest.approx(r["yhat"]) and step == (r["ds"] - day(origin)).days


def test_days_are_joined_by_date_and_errors_measured(spark):
    table = daily(spark, 100, gaps={95})
    ahead = spark.createDataFrame(
        [("a", day(93 + s), 20.0, 10.0, 15.0, s) for s in range(1, 9)] + [("z", day(94), 1.0, 0.0, 2.0, 1)],
        "k string, ds date, yhat double, lower double, upper double, step int")
    got = forecast.on_days(ahead, table, "v", ["k"])
    actual = {(r["k"], r["step"]): (r["actual"], r["inside"]) for r in got.collect()}
    want = {s: 10.0 + (93 + s) % 7 for s in range(1, 7)} | {2: 0.0}
    assert {s: actual["a", s][0] for s in range(1, 7)} == want
    assert actual["a", 7] == (None, None) and actual["z", 1] == (0.0, True)
    r = forecast.error_measures(got.where("k = 'a'"), ["k"]).first()
    errors = [20 - v for v in want.values()]
    assert (r["n_days"], r["bias"]) == (6, pytest.approx(sum(errors) / 6))
    assert r["rmse"] == pytest.approx(math.sqrt(sum(e * e for e in errors) / 6))
    assert r["wape"] == pytest.approx(sum(errors) / sum(want.values()) * 100)
    assert r["coverage"] == pytest.approx(sum(10 <= v <= 15 for v in want.values()) / 6)
    with pytest.raises(ValueError):
        forecast.rolling_origins(table, "v", "other")

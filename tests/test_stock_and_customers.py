import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merchlight.functions.quantiles import exact_quantiles
from merchlight.operators import advise, customers, inventory
from tests.conftest import day


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60),
       accuracy=st.sampled_from([2, 10, 10_000]))
def test_exact_quantiles_equal_numpy(spark, values, accuracy):
    """Also with a sketch far too coarse: the brackets widen until they hold the rank."""
    probs = [0.0, 1 / 3, 0.5, 0.8, 1.0]
    df = spark.createDataFrame([(float(v), v * 2) for v in values], "x double, y int")
    got = exact_quantiles(df, ["x", "y"], probs, accuracy)
    assert got["x"] == pytest.approx(list(np.quantile(values, probs)))
    assert got["y"] == pytest.approx(list(np.quantile([v * 2 for v in values], probs)))


def test_exact_quantiles_with_a_dominant_value(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.0)
                                    .otherwise(F.col("id") * 0.5).alias("x"))
    values = [7.0 if i % 3 == 0 else i * 0.5 for i in range(30_000)]
    probs = [0.01, 1 / 3, 2 / 3, 0.95]
    assert exact_quantiles(df, ["x"], probs)["x"] == pytest.approx(
        list(np.quantile(values, probs)))


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_rfm_scores_and_segments(spark):
    rows = [(c, day(10 * c), c * 100.0) for c in range(1, 10) for _ in range(c)]
    orders = spark.createDataFrame(rows, "customer_id int, date date, revenue double")
    got = {r.customer_id: r for r in customers.rfm_segments(orders).collect()}
    assert (got[9].r_score, got[9].f_score, got[9].m_score) == (3, 3, 3)
    assert (got[1].r_score, got[1].f_score, got[1].m_score) == (1, 1, 1)
    assert got[9].segment == "Champions" and got[1].segment == "At-Risk"
    assert got[5].segment == "Loyal" and got[9].recency == 0
    plan = {r.customer_id: r for r in
            advise.retention_actions(customers.rfm_segments(orders)).collect()}
    assert plan[9].is_top_customer and plan[9].priority == "low"
    assert plan[1].priority == "medium" and plan[1].action == "win_back_offer"


def test_rfm_without_customers(spark):
    orders = spark.createDataFrame([], "customer_id int, date date, revenue double")
    assert customers.rfm_segments(orders).count() == 0


@pytest.mark.parametrize("days,kind", [(14.9, "critical"), (15, "low"), (19.9, "low"),
                                       (20, "healthy"), (90, "healthy"), (90.1, "overstock")])
def test_risk_bounds(spark, days, kind):
    assert spark.range(1).select(inventory.risk_class(F.lit(days)).alias("k")).first().k == kind


@pytest.mark.parametrize("kinds", ["product_id int, last_updated date, quantity_on_hand int",
                                   "product_id int, last_updated timestamp, "
                                   "quantity_on_hand bigint"])
def test_latest_inventory_packed_and_struct(spark, kinds):
    when = day if "date" in kinds.split(",")[1].split()[1:] else \
        (lambda n: dt.datetime.combine(day(n), dt.time(8)))
    rows = [(1, when(3), 5), (1, when(9), 2), (1, when(9), 4), (2, when(1), 0),
            (3, when(-20_000), 2 ** 31 - 1), (3, when(-20_001), 7), (4, None, 5)]
    df = spark.createDataFrame(rows, kinds)
    got = {r.product_id: (r.quantity_on_hand, r.last_updated)
           for r in inventory.latest_inventory(df).collect()}
    assert got == {1: (4, when(9)), 2: (0, when(1)), 3: (2 ** 31 - 1, when(-20_000))}


def test_positions_keep_products_without_sales_or_stock(spark):
    products = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "c", 10)],
                                     "product_id int, product_name string, reorder_level int")
    stock = spark.createDataFrame([(1, 60), (2, 5)], "product_id int, quantity_on_hand int")
    lines = spark.createDataFrame([(1, day(30), 60), (1, day(0), 999)],
                                  "product_id int, date date, quantity int")
    demand = inventory.demand_rate(lines, as_of=day(30))     # day(0) is out, day(1) in
    position = inventory.stock_position(products, stock, demand)
    got = {r.product_id: r for r in inventory.inventory_status(position).collect()}
    assert (got[1].daily_demand, got[1].days_of_stock, got[1].risk) == (2, 30, "healthy")
    assert (got[2].days_of_stock, got[2].risk, got[2].below_reorder) == (999, "no_demand", True)
    assert (got[3].quantity_on_hand, got[3].below_reorder) == (0, True)
    needs = {r.product_id: r.restock_quantity
             for r in inventory.inventory_needs(position, 30, 14).collect()}
    assert needs == {1: 28, 2: 0, 3: 0}
    assert inventory.restock_list(position).count() == 0     # 30 days left: not urgent


def test_supply_days_without_sales(series):
    daily = series([0, 0], inventory_level=[5, 5])
    got = inventory.inventory_health(daily).first()
    assert got.days_of_supply == 999 and got.alert is False


def test_pricing_prefers_the_discount_for_slow_movers(spark):
    rows = [(i, f"p{i}", "c", 10 * i, float(100 * i)) for i in range(2, 11)]
    rows.append((1, "p1", "c", 1, 99.0))             # few units, highest unit revenue
    table = spark.createDataFrame(
        rows, "product_id int, product_name string, category string, quantity int, "
              "revenue double")
    got = {r.product_id: r for r in advise.pricing_suggestions(table).collect()}
    assert got[1].reason == "slow_mover" and got[1].price_change_pct == -10
    assert got[1].suggested_price == pytest.approx(89.1)


def test_inventory_anomalies(spark):
    rows = [(i, f"p{i}", 1.0, 30.0, "healthy") for i in range(50)]
    rows += [(90, "far", 1.0, 900.0, "overstock"), (91, "out", 1.0, 2.0, "critical"),
             (92, "idle", 0.0, 999.0, "no_demand")]
    status = spark.createDataFrame(rows, "product_id int, product_name string, "
                                         "daily_demand double, days_of_stock double, risk string")
    got = {r.product_id: r.anomaly_type for r in inventory.inventory_anomalies(status).collect()}
    assert got == {90: "excess_stock", 91: "stock_out_risk"}

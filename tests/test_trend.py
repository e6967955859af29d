import pytest
from pyspark.sql import functions as F

from merchlight.operators import kpi, trend
from tests.conftest import day


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_period_exactly_two_periods(series):
    daily = series([10] * 30 + [5] * 30)
    live = one(trend.period_over_period(daily, "total_sales"))
    assert (live.recent_mean, live.previous_mean, live.change_pct) == (5, 10, -50)
    # the strict variant needs more than 60 rows
    same = one(trend.period_over_period(daily, "total_sales", short="same"))
    assert (same.recent_mean, same.previous_mean, same.change_pct) == (5, 5, 0)


def test_period_short_history_overlaps(series):
    values = list(range(1, 60))     # 59 rows: previous is rows 1-30, recent 30-59
    r = one(trend.period_over_period(series(values), "total_sales"))
    assert r.recent_mean == sum(range(30, 60)) / 30
    assert r.previous_mean == sum(range(1, 31)) / 30


def test_period_fewer_rows_than_one_period(series):
    r = one(trend.period_over_period(series([2, 4]), "total_sales"))
    assert (r.recent_mean, r.previous_mean, r.change_pct) == (3, 3, 0)


def test_strict_variant_beyond_two_periods(series):
    r = one(trend.period_over_period(series([99] + [10] * 30 + [5] * 30), "total_sales",
                                     short="same"))
    assert (r.recent_mean, r.previous_mean) == (5, 10)


def test_previous_zero_gives_zero_change(series):
    r = one(trend.period_over_period(series([0] * 30 + [5] * 30), "total_sales"))
    assert r.change_pct == 0


def test_drop_is_strict_at_the_threshold(series):
    exact = series([100] * 30 + [85] * 30, revenue=[200] * 60)
    r = one(trend.sales_drop(exact))
    assert r.change_pct == -15 and r.is_drop is False
    r = one(trend.sales_drop(series([100] * 30 + [84] * 30, revenue=[200] * 60)))
    assert r.is_drop is True
    assert r.lost_revenue == pytest.approx(0.16 * 200)


def test_nulls_are_skipped_in_means(series):
    r = one(trend.period_over_period(series([None, 4, 2]), "total_sales", period=3))
    assert r.recent_mean == 3


def test_empty_series(series):
    r = one(trend.period_over_period(series([]), "total_sales"))
    assert r.recent_mean is None and r.change_pct == 0


def test_keys_run_side_by_side(spark):
    rows = [(k, day(i), float(v)) for k, vs in {"a": [1] * 30 + [2] * 30, "b": [4, 4]}.items()
            for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "shop string, date date, total_sales double")
    got = {r.shop: r.change_pct for r in
           trend.period_over_period(df, "total_sales", keys=["shop"]).collect()}
    assert got == {"a": 100.0, "b": 0.0}


def test_day_over_day(series):
    got = [r.change_pct for r in
           trend.day_over_day(series([10, 15, 0, 5]), "total_sales").orderBy("date").collect()]
    assert got == [None, 50, -100, None]


def test_moving_average(series):
    got = [r.moving_average for r in trend.moving_average(
        series([1, 2, 3, 4]), "total_sales", 3).orderBy("date").collect()]
    assert got == [1, 1.5, 2, 3]


def test_since_bounds(series):
    df = series([1] * 100)
    as_of = F.lit(day(90)).cast("date")
    assert trend.since(df, as_of, 30).count() == 31           # both ends count
    assert trend.since(df, as_of, 60, until=30).count() == 30


def test_correlation_of_a_constant_is_null(series):
    df = series([1, 2, 3], inventory_level=[5, 5, 5])
    assert one(trend.metric_correlation(df, "total_sales", "inventory_level")) \
        .correlation is None
    df = series([1, 2, None], inventory_level=[2, 4, 9])
    r = one(trend.metric_correlation(df, "total_sales", "inventory_level"))
    assert (r.n_days, r.correlation) == (2, pytest.approx(1))


def test_categories_by_name_and_tie_order(series):
    df = series([9, 9], b_sales=[1, 5], a_sales=[9, 5], stock=[1, 1])
    assert trend.category_columns(df) == ["b_sales", "a_sales"]
    best = trend.top_categories(df, 2).orderBy("rank").collect()
    assert [(r.category, r.display_name) for r in best] == [("b_sales", "B"),
                                                            ("a_sales", "A")]
    means = {r.category: r.mean_sales for r in trend.category_means(df, 7).collect()}
    assert means == {"b_sales": 3, "a_sales": 7}


def test_wide_and_long_round_trip(spark):
    long = spark.createDataFrame([(day(0), "Home", 2.0), (day(1), "Toys", 3.0)],
                                 "date date, category string, sales double")
    wide = trend.daily_wide(long, ["Home", "Toys"])
    assert wide.columns == ["date", "home_sales", "toys_sales"]
    back = {(r.date, r.display_name): r.sales for r in trend.unpivot_categories(wide).collect()}
    assert back == {(day(0), "Home"): 2, (day(0), "Toys"): 0,
                    (day(1), "Home"): 0, (day(1), "Toys"): 3}
    assert sorted(trend.daily_wide(long).columns) == sorted(wide.columns)


def test_snapshot_agrees_with_the_single_operators(series):
    values = [100 + (i * 37) % 23 for i in range(80)]
    daily = series(values, revenue=[v * 3 for v in values],
                   inventory_level=[500 + i for i in range(80)],
                   customers=[i % 9 for i in range(80)],
                   x_sales=[v / 2 for v in values], y_sales=[v / 3 for v in values])
    state = one(kpi.business_snapshot(daily))
    drop = one(trend.sales_drop(daily))
    assert state.change_pct == drop.change_pct
    assert state.lost_revenue == drop.lost_revenue
    assert [c.category for c in state.top_categories] == ["x_sales", "y_sales"]
    assert state.revenue_recent == pytest.approx(3 * sum(values[-30:]))
    assert state.mean_customers == pytest.approx(sum(i % 9 for i in range(73, 80)) / 7)
    cards = one(kpi.kpi_cards(daily))
    assert cards.latest_sales == values[-1]
    assert cards.sales_day_change_pct == pytest.approx(
        (values[-1] - values[-2]) / values[-2] * 100)

import datetime as dt

import numpy as np
import pytest

from merchlight.operators import forecast, many_series
from merchlight.operators.forecast import _fit_holt_winters
from tests.conftest import day

WEEK = [0, 5, -3, 8, 1, -9, -2]


def weekly(n):
    return [100 + 2.5 * i + WEEK[i % 7] for i in range(n)]


def test_fill_days(spark):
    df = spark.createDataFrame([(day(0), 4.0), (day(3), 6.0)], "date date, v double")
    got = [(r.ds, r.y) for r in forecast.fill_days(df, "v").orderBy("ds").collect()]
    assert got == [(day(0), 4), (day(1), 0), (day(2), 0), (day(3), 6)]


def test_holt_winters_continues_an_exact_pattern(series):
    n, h = 70, 30
    got = forecast.holt_winters(series(weekly(n)), "total_sales", h).orderBy("ds").collect()
    want = weekly(n + h)[n:]
    assert [r.yhat for r in got] == pytest.approx(want, rel=1e-6)
    assert [r.ds for r in got] == [day(n + i) for i in range(h)]
    assert got[0].upper - got[0].lower == pytest.approx(0, abs=1e-4)


def noisy(n, seed=5):
    rng = np.random.default_rng(seed)
    level = 200 + np.cumsum(rng.normal(0, 2, n))
    return level + np.resize(WEEK, n) + rng.normal(0, 3, n)


def recursion(y, params, starts, season=7):
    """One-step errors by the textbook recursion, one value at a time."""
    a, b, c = params
    level, trend, slots = starts[0], starts[1], list(starts[2:])
    errors = []
    for t, value in enumerate(y):
        old, s = level, slots[t % season]
        errors.append(value - (level + trend + s))
        level = a * (value - s) + (1 - a) * (level + trend)
        slots[t % season] = c * (value - old - trend) + (1 - c) * s
        trend = (b * (level - old) + (1 - b) * trend)
    return np.array(errors)


def padded(*series):
    n = np.array([len(y) for y in series])
    table = np.zeros((len(series), n.max()))
    for i, y in enumerate(series):
        table[i, :len(y)] = y
    return many_series.Smoothing(table, n, 7)


@pytest.mark.parametrize("shared", [True, False])
def test_solved_starts_are_the_least_squares_ones(shared):
    series = [noisy(60), noisy(200, 6), noisy(33, 7)]
    cells = np.array([[0.3, 0.1, 0.2], [0.0, 0.0, 0.0], [0.9, 0.4, 0.05]])
    params = cells[None] if shared else np.stack([cells, cells[::-1], cells])
    cost, starts = padded(*series).solve(params)
    for s, y in enumerate(series):
        for c in range(len(cells)):
            weights = params[0 if shared else s, c]
            best = (recursion(y, weights, starts[s, c]) ** 2).sum()
            assert cost[s, c] == pytest.approx(best, rel=1e-6)
            rng = np.random.default_rng(c)
            for _ in range(20):      # no other start does better
                other = recursion(y, weights, starts[s, c] + rng.normal(0, 0.5, 9))
                assert (other ** 2).sum() >= cost[s, c] * (1 - 1e-9)


def test_runs_of_ragged_series_equal_the_recursion():
    series = [noisy(60), noisy(200, 6), noisy(33, 7)]
    params = np.array([[0.3, 0.1, 0.2], [0.1, 0.0, 0.4], [0.9, 0.4, 0.05]])
    starts = np.random.default_rng(2).normal(100, 5, (3, 9))
    errors, *_ = padded(*series).run(params, starts)
    for i, y in enumerate(series):
        assert errors[i, :len(y)] == pytest.approx(recursion(y, params[i], starts[i]), abs=1e-8)
        assert not errors[i, len(y):].any()


def test_fit_is_at_least_as_good_as_a_random_search():
    y = noisy(120)
    _, residuals = _fit_holt_winters(y, 7, 5)
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 1, 1000)
    params = np.column_stack([a, a * rng.uniform(0, 1, 1000), (1 - a) * rng.uniform(0, 1, 1000)])
    cost, _ = padded(y).solve(params[None])
    assert (residuals ** 2).sum() <= cost.min() * 1.001


def test_no_weights_of_a_series_are_solved_twice(monkeypatch):
    seen = []
    solve_own = many_series.Smoothing.solve_own

    def counted(self, rows, params):
        seen.extend((i, tuple(p)) for i, p in zip(rows.tolist(), params.tolist()))
        return solve_own(self, rows, params)

    monkeypatch.setattr(many_series.Smoothing, "solve_own", counted)
    rng = np.random.default_rng(2)
    series = [np.where(rng.random(200) < 0.05, 7.0, 0.0) for _ in range(10)]   # no season, no trend
    many_series.fit_holt_winters(series, 7, 5)
    searched = seen[:-len(series)]                  # the last ones are the chosen
    assert len(set(searched)) == len(searched) < 0.6 * 27 * many_series.ROUNDS * len(series)


def test_many_series_equal_each_alone():
    rng = np.random.default_rng(3)
    series = [noisy(int(n), k) for k, n in enumerate(rng.integers(14, 300, 30))]
    series += [np.zeros(20), np.full(50, 12.0), np.array(weekly(70))]
    many = many_series.fit_holt_winters(series, 7, 9)
    for y, (yhat, residuals) in zip(series, many):
        alone = many_series.fit_holt_winters([y], 7, 9)[0]
        assert yhat == pytest.approx(alone[0], abs=1e-9) and len(residuals) == len(y)
        assert residuals == pytest.approx(alone[1], abs=1e-9)


def test_planted_bends_are_found():
    rng = np.random.default_rng(11)
    found = missed = false = 0
    for _ in range(30):
        n, places = 400, sorted(rng.choice(np.arange(60, 340, 20), 2, replace=False))
        slopes = rng.choice([-1, 1], 2) * rng.uniform(1.0, 2.5, 2)
        t = np.arange(n)
        y = 100 + 0.3 * t + np.resize(WEEK, n) + rng.normal(0, 6, n)
        for place, slope in zip(places, slopes):
            y = y + slope * np.maximum(t - place, 0)
        bends = many_series.fit_bends(y, 5, 25, 3, 0, 0.95)[3]
        near = [min((abs(b - p) for b in bends[:, 0]), default=999) for p in places]
        found += sum(x <= 15 for x in near)
        missed += sum(x > 15 for x in near)
        false += sum(min(abs(b - p) for p in places) > 30 for b in bends[:, 0])
    assert found >= 57 and false <= 6, (found, missed, false)
    plain = [len(many_series.fit_bends(100 + 0.3 * np.arange(300) + rng.normal(0, 5, 300),
                                       5, 25, 3, 0, 0.95)[3]) for _ in range(40)]
    assert sum(plain) <= 4


@pytest.mark.parametrize("level", [0.8, 0.95])
def test_intervals_cover_held_out_days(level):
    """Skewed errors, bends and a week; the next 14 days lie inside as often as stated."""
    rng, inside, days = np.random.default_rng(12), 0, 0
    for _ in range(150):
        n, t = 300, np.arange(314)
        y = 50 + 0.2 * t + np.resize(WEEK, 314) + rng.gamma(2.0, 4.0, 314)
        y = y + rng.choice([0, 1.0]) * np.maximum(t - 150, 0)
        _, lower, upper, _ = many_series.fit_bends(y[:n], 14, 25, 3, 0, level)
        inside += ((y[n:] >= lower) & (y[n:] <= upper)).sum()
        days += 14
    assert inside / days == pytest.approx(level, abs=0.03)


def test_soft_path_equals_a_projected_search():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6))
    y = x @ np.array([3, 0, 0, -2, 0, 0.5]) + rng.normal(0, 0.1, 80)
    for penalty in (1.0, 20.0, 90.0):
        weights = many_series.soft_path(x.T @ x, x.T @ y, np.array([penalty]), 500, 1e-9)[0]
        pull = x.T @ (y - x @ weights)          # the conditions of the minimum
        assert (np.abs(pull) <= penalty * (1 + 1e-5) + 1e-5).all()
        on = weights != 0
        assert pull[on] == pytest.approx(penalty * np.sign(weights[on]), rel=1e-4)


def test_interval_width_and_row_order(series):
    y = list(noisy(90))
    daily = series(y)
    got = forecast.holt_winters(daily, "total_sales").orderBy("ds").collect()
    _, residuals = _fit_holt_winters(np.array(y), 7, 30)
    for r in got:
        assert r.upper - r.lower == pytest.approx(2 * 1.96 * residuals.std())
    shuffled = forecast.holt_winters(daily.orderBy("total_sales"), "total_sales")
    assert [r.yhat for r in shuffled.orderBy("ds").collect()] == [r.yhat for r in got]


def test_short_series_fall_back_to_the_mean(series):
    got = forecast.holt_winters(series([3, 5, 7]), "total_sales", 4).collect()
    assert [r.yhat for r in got] == [5] * 4
    got = forecast.seasonal_forecast(series([3, 5, 7]), "total_sales", 4).collect()
    assert [r.yhat for r in got] == [5] * 4


def test_short_series_with_gaps_equal_the_moving_average(series):
    gappy = series([10, None, 20, None, 30]).where("date IN ('2024-01-01', '2024-01-05')")
    for method in (forecast.holt_winters, forecast.seasonal_forecast):
        got = method(gappy, "total_sales", 4)
        want = forecast.moving_average_forecast(gappy, "total_sales", 4)
        assert {r["method"] for r in got.collect()} == {"moving_average"}
        assert got.drop("method").orderBy("ds").collect() == want.orderBy("ds").collect()
    rows = forecast.holt_winters(series(range(40)), "total_sales", 2).collect()
    assert {r["method"] for r in rows} == {"holt_winters"}


def test_constant_and_zero_series(series):
    for value in (0, 12):
        got = forecast.holt_winters(series([value] * 30), "total_sales", 3).collect()
        assert [r.yhat for r in got] == pytest.approx([value] * 3, abs=1e-9)


def test_moving_average_forecast(series):
    got = forecast.moving_average_forecast(series([100] + [2, 4] * 15), "total_sales", 2)
    rows = got.orderBy("ds").collect()
    assert [(r.ds, r.yhat) for r in rows] == [(day(31), 3), (day(32), 3)]
    assert rows[0].upper == pytest.approx(3 + 1.96)
    assert forecast.moving_average_forecast(series([]), "total_sales").count() == 0


def test_seasonal_forecast_follows_trend_and_week(series):
    n, h = 200, 21
    got = forecast.seasonal_forecast(series(weekly(n)), "total_sales", h).orderBy("ds").collect()
    assert [r.yhat for r in got] == pytest.approx(weekly(n + h)[n:], rel=1e-3)


def test_seasonal_forecast_sees_the_year(series):
    n, h = 900, 60
    def truth(i):
        return 500 + 100 * np.sin(2 * np.pi * i / 365.25)
    got = forecast.seasonal_forecast(series([truth(i) for i in range(n)]), "total_sales", h)
    want = [truth(n + i) for i in range(h)]
    assert [r.yhat for r in got.orderBy("ds").collect()] == pytest.approx(want, rel=0.03)


def test_revenue_forecast_of_one_product(spark):
    rows = [(day(i), p, float(v)) for i, v in enumerate(weekly(100))
            for p, v in (("rod", v), ("bolt", 1000.0))]
    sales = spark.createDataFrame(rows, "date date, product_name string, revenue double")
    got = forecast.revenue_forecast(sales, 7, product="rod").orderBy("ds").collect()
    assert [r.yhat for r in got] == pytest.approx(weekly(107)[100:], rel=1e-3)
    both = forecast.revenue_forecast(sales, 7).orderBy("ds").collect()
    assert [r.yhat for r in both] == pytest.approx([v + 1000 for v in weekly(107)[100:]],
                                                   rel=1e-3)
    with pytest.raises(ValueError):
        forecast.revenue_forecast(sales, 120)


def test_change_points_by_series(spark):
    t = range(200)
    rows = [(k, day(i), 10.0 + i + (3.0 * max(i - 100, 0) if k == "b" else 0)) for k in "ab" for i in t]
    daily = spark.createDataFrame(rows + [("c", day(0), 1.0)], "k string, date date, v double")
    got = forecast.change_points(daily, "v", ["k"]).collect()
    assert {r["k"] for r in got} == {"b"}
    assert sum(r["slope_change"] for r in got) == pytest.approx(3, rel=0.05)
    assert all(abs((r["date"] - day(100)).days) <= 8 for r in got)


def test_fitted_demand_ends_today_and_has_every_product(spark):
    rows = [(1, day(i), 1 + (i % 7)) for i in range(100)] + [(2, day(5), 70), (4, day(96), 3)]
    sales = spark.createDataFrame(rows, "product_id int, date date, quantity int")
    products = spark.createDataFrame([(i,) for i in range(1, 6)], "product_id int")
    got = forecast.demand_forecast(sales, 7, as_of=day(99), method="holt_winters",
                                   products=products, history=56)
    by = {}
    for r in got.orderBy("ds").collect():
        by.setdefault((r["product_id"], r["method"]), []).append((r["ds"], r["yhat"]))
    assert set(by) == {(1, "holt_winters"), (2, "no_sales"), (3, "no_sales"),
                       (4, "moving_average"), (5, "no_sales")}
    assert all([d for d, _ in v] == [day(100 + i) for i in range(7)] for v in by.values())
    assert [v for _, v in by[1, "holt_winters"]] == pytest.approx([1 + (100 + i) % 7 for i in range(7)])
    assert [v for _, v in by[4, "moving_average"]] == pytest.approx([3 / 4] * 7)
    alone = forecast.holt_winters(sales.where("product_id = 1 AND date > '2024-02-13'"), "quantity", 7)
    assert [r["yhat"] for r in alone.orderBy("ds").collect()] == pytest.approx(
        [v for _, v in by[1, "holt_winters"]])


def test_odd_daily_rows(spark):
    daily = spark.createDataFrame(
        [(None, day(0), 1.0), ("a", None, 5.0), ("a", day(0), None), ("a", day(2), 3.0),
         ("a", day(2), 1.0), ("b", None, None)], "k string, date date, v double")
    for method in (forecast.holt_winters, forecast.seasonal_forecast):
        got = {(r["k"], r["ds"]): r["yhat"] for r in method(daily, "v", 2, keys=["k"]).collect()}
        assert got == {(None, day(1)): 1, (None, day(2)): 1, ("a", day(3)): 4, ("a", day(4)): 4}
        assert method(daily.limit(0), "v", 2).count() == 0
        assert method(daily.limit(0), "v", 2, keys=["k"]).count() == 0


def test_demand_methods(spark):
    rows = [(p, day(i), 1 + (i % 7)) for p in (1, 2) for i in range(40)] + [(3, day(39), 30)]
    sales = spark.createDataFrame(rows, "product_id int, date date, quantity int")
    flat = {(r.product_id, r.ds): r.yhat for r in
            forecast.demand_forecast(sales, 7, as_of=day(39)).collect()}
    assert len(flat) == 21 and flat[(3, day(40))] == 1
    for method in ("holt_winters", "seasonal"):
        got = forecast.demand_forecast(sales, 7, method=method).collect()
        assert len(got) == 21
    exact = {(r.product_id, r.ds): r.yhat for r in
             forecast.demand_forecast(sales, 7, method="holt_winters").collect()}
    assert exact[(1, day(41))] == pytest.approx(1 + 41 % 7, rel=1e-6)
    with pytest.raises(ValueError):
        forecast.demand_forecast(sales, method="other")


def test_forecast_vs_actual(series):
    daily = series([10] * 30)
    ahead = forecast.moving_average_forecast(series([12] * 5), "total_sales")
    got = forecast.forecast_vs_actual(ahead, daily, "total_sales").first()
    assert (got.forecast_mean, got.actual_mean, got.delta) == (12, 10, 2)

"""Forecasts per series, long form: key..., ds, yhat, lower, upper.

A series is day-grain: the Python groups hold at most one row per calendar day
of one series, and series run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchlight.functions.measures import by_keys, mean_of, resolve_as_of
from merchlight.operators import many_series
from merchlight.operators.trend import trailing_rows, with_age
from merchlight.session import spread

# Fixed value: half width of the interval in residual deviations.
INTERVAL = 1.96
#: Series held as arrays at one time; those of like length are fitted together.
TOGETHER = 5 * many_series.SERIES


def fill_days(daily: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per calendar day between the first and last date; gaps become 0.

    Each row spreads itself up to the day before the next one: no second scan
    and no join with a calendar.
    """
    upcoming = F.lead("date").over(by_keys(keys).orderBy("date"))
    rows = daily.select(*keys, "date", F.col(value).cast("double").alias("_y")) \
                .withColumn("_last", F.coalesce(F.date_sub(upcoming, 1), F.col("date")))
    days = rows.withColumn("ds", F.explode(F.sequence("date", "_last")))
    amount = F.when(F.col("ds") == F.col("date"), F.coalesce("_y", F.lit(0.0)))
    return days.select(*keys, "ds", amount.otherwise(0.0).alias("y"))


def moving_average_forecast(daily: DataFrame, value: str, periods: int = 30,
                            keys: Sequence[str] = (), window: int = 30) -> DataFrame:
    """Flat forecast at the mean of the last ``window`` rows."""
    recent = with_age(daily, window, keys=keys)
    level = recent.groupBy(*keys).agg(
        F.max("date").alias("_last"), mean_of(value).alias("yhat"),
        F.stddev_pop(F.col(value).cast("double")).alias("_std"))
    return _spread(level, periods, keys)


def _spread(level: DataFrame, periods: int, keys: Sequence[str]) -> DataFrame:
    """One row per future day from a level and a deviation."""
    known = level.filter(F.col("_last").isNotNull())
    days = known.withColumn("ds", F.explode(F.sequence(
        F.date_add("_last", 1), F.date_add("_last", periods))))
    width = F.col("_std") * INTERVAL
    return days.select(*keys, "ds", "yhat", (F.col("yhat") - width).alias("lower"),
                       (F.col("yhat") + width).alias("upper"))


# -- Holt-Winters ----------------------------------------------------------------


def holt_winters(daily: DataFrame, value: str, horizon: int = 30, season: int = 7,
                 keys: Sequence[str] = (), until=None) -> DataFrame:
    """Additive trend and season by exponential smoothing, fitted per series.

    The three smoothing parameters and the starting states minimise the squared
    one-step errors. For given parameters the errors are linear in the starting
    states, so these are solved by least squares and only the parameters are
    searched, for many series at once. Series shorter than two seasons get the flat
    moving average. The interval is ``yhat +- 1.96`` population deviations of the
    residuals. ``until``: the last day of every series (default: its last row).
    """
    def fit(series: list[np.ndarray]) -> list[tuple]:
        out = []
        for yhat, residuals in many_series.fit_holt_winters(series, season, horizon):
            width = INTERVAL * residuals.std()
            out.append((yhat, yhat - width, yhat + width))
        return out

    return _per_series(daily, value, keys, horizon, 2 * season, fit, "holt_winters", until)


def _per_series(daily, value, keys, horizon, shortest, fit, fitted, until=None) -> DataFrame:
    """Fits of whole batches of series; ``method`` says which rule gave the rows.

    A series travels as its given days and values alone, one row each; days between
    them count 0, several rows of a day are added up. ``until`` ends all series.
    """
    key_list = list(keys)
    last_day = F.lit(None).cast("int") if until is None else F.unix_date(until)
    rows = daily.where(F.col("date").isNotNull()).select(
        *keys, F.unix_date("date").alias("_d"), F.col(value).cast("double").alias("_y"),
        last_day.alias("_until"))
    if until is not None:
        rows = rows.where(F.col("_d") <= F.col("_until"))
    rows = spread(rows, *keys) if keys else rows    # before the aggregate, which keeps it
    series = rows.groupBy(*keys).agg(F.collect_list(F.struct("_d", "_y")).alias("_rows"),
                                     F.max("_until").alias("_until"))
    fields = [f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*fields, "ds date", "yhat double", "lower double", "upper double",
                        "method string"])
    steps = np.arange(1, horizon + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield some(batch.slice(at, TOGETHER))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        dense, given, last = [], [], []
        for found, end in zip(batch.column("_rows").to_pylist(), batch.column("_until").to_pylist()):
            by_day: dict[int, float | None] = {}
            for r in sorted(found, key=lambda r: r["_d"]):
                if r["_y"] is not None:
                    by_day[r["_d"]] = (by_day.get(r["_d"]) or 0.0) + r["_y"]
                else:
                    by_day.setdefault(r["_d"], None)
            days = list(by_day)
            last.append((days[-1] if end is None else end) if days else None)
            y = np.zeros(last[-1] - days[0] + 1 if days else 0)
            for d, v in by_day.items():
                y[d - days[0]] = v or 0.0
            dense.append(y)
            given.append(list(by_day.values()) if end is None else list(y))
        long = [i for i, y in enumerate(dense) if len(y) >= shortest]
        fits = dict(zip(long, fit([dense[i] for i in long]))) if long else {}
        kept, ds, bounds, methods = [], [], [], []
        for i, day in enumerate(last):
            if day is None:
                continue
            if i in fits:
                bounds.append(np.stack(fits[i]))
            else:                 # as moving_average_forecast: rows, not filled days
                recent = np.array([v for v in given[i][-30:] if v is not None])
                level, width = (recent.mean(), INTERVAL * recent.std()) if len(recent) \
                    else (np.nan, np.nan)
                bounds.append(np.repeat([[level], [level - width], [level + width]], horizon, 1))
            kept.append(i)
            ds.append(day + steps)
            methods += [fitted if i in fits else "moving_average"] * horizon
        table = np.concatenate(bounds, 1) if bounds else np.zeros((3, 0))
        take = pa.array(np.repeat(kept, horizon).astype(np.int64))
        return pa.record_batch(
            [*(batch.column(k).take(take) for k in key_list),
             pa.array(np.concatenate([*ds, np.zeros(0)]).astype(np.int32)).cast(pa.date32()),
             *(pa.array(x, from_pandas=True) for x in table), pa.array(methods, pa.string())],
            names=[*key_list, "ds", "yhat", "lower", "upper", "method"])

    return series.mapInArrow(run, schema)


def _fit_holt_winters(y: np.ndarray, season: int,
                      horizon: int) -> tuple[np.ndarray, np.ndarray]:
    return many_series.fit_holt_winters([y], season, horizon)[0]


# -- Trend, change points and seasonality by regression ---------------------------


def seasonal_forecast(daily: DataFrame, value: str, periods: int = 30,
                      keys: Sequence[str] = (), change_points: int = 25,
                      weekly_terms: int = 3, yearly_terms: int = 5, yearly_from: int = 731,
                      level: float = 0.95, until=None) -> DataFrame:
    """Trend with change points plus weekly and yearly waves, by least squares.

    The model shape follows Taylor and Letham (2018): a linear trend that may bend
    at some of ``change_points`` evenly spaced dates in the first 90 % of the history,
    and sine / cosine pairs for the week and, for histories of at least ``yearly_from``
    days, for the year. An L1 penalty proposes few bends, which are then fitted without
    penalty. The interval covers ``level`` of the days by the quantiles of the
    residuals. Series shorter than two weeks and than the terms need get the flat
    moving average. ``until``: the last day of every series (default: its last row).
    """
    def fit(series: list[np.ndarray]) -> list[tuple]:
        return [many_series.fit_bends(
            y, periods, change_points, weekly_terms, yearly_terms if len(y) >= yearly_from else 0,
            level)[:3] for y in series]

    return _per_series(daily, value, keys, periods, 2 * (2 + 2 * weekly_terms) + 7, fit,
                       "seasonal", until)


def change_points(daily: DataFrame, value: str, keys: Sequence[str] = (), candidates: int = 25,
                  weekly_terms: int = 3, yearly_terms: int = 5,
                  yearly_from: int = 731) -> DataFrame:
    """The bends of the trend that ``seasonal_forecast`` chooses: key..., date, slope change.

    ``slope_change`` is in units of the value per day. Series too short for a fit, and
    those without a bend, have no row.
    """
    shortest = 2 * (2 + 2 * weekly_terms) + 7

    def fit(y: np.ndarray) -> np.ndarray:
        return many_series.fit_bends(y, 1, candidates, weekly_terms,
                                     yearly_terms if len(y) >= yearly_from else 0, 0.95)[3]

    filled = fill_days(daily, value, keys)
    key_list = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        bends = fit(pdf["y"].to_numpy(dtype=float)) if len(pdf) >= shortest else np.zeros((0, 2))
        out = pd.DataFrame({"date": pdf["ds"].to_numpy()[bends[:, 0].astype(int)],
                            "slope_change": bends[:, 1]})
        for k in key_list:
            out[k] = pdf[k].iloc[0]
        return out[[*key_list, "date", "slope_change"]]

    fields = [f"`{k}` {filled.schema[k].dataType.simpleString()}" for k in keys]
    groups = spread(filled, *keys) if keys else filled
    return groups.groupBy(*keys).applyInPandas(run, ", ".join(
        [*fields, "date date", "slope_change double"]))


# -- Demand and comparison ---------------------------------------------------------


def demand_forecast(sales: DataFrame, periods: int = 30, as_of=None, window: int = 30,
                    method: str = "moving_average", products: DataFrame | None = None,
                    history: int | None = None) -> DataFrame:
    """Units per product and future day.

    ``sales`` is one row per product and date with a sale. The default is the flat
    mean over the last ``window`` calendar days (days without a sale count as 0).
    ``holt_winters`` and ``seasonal`` fit each product's days from its first sale (of
    the last ``history`` days, if given) to ``as_of``, floored at 0, and fall back to
    the flat mean where there are too few; ``method`` says which rule was used. With
    ``products``, those without a sale in that time follow with 0 and ``no_sales``.
    """
    if method in ("holt_winters", "seasonal"):
        today = resolve_as_of(sales, as_of)
        recent = sales.where(F.col("date") > F.date_sub(today, history)) if history else sales
        fit = holt_winters if method == "holt_winters" else seasonal_forecast
        fitted = fit(recent, "quantity", periods, keys=["product_id"], until=today).withColumns(
            {c: F.greatest(F.col(c), F.lit(0.0)) for c in ("yhat", "lower", "upper")})
        if products is None:
            return fitted
        zero = F.lit(0.0)
        without = products.select("product_id").join(
            recent.where(F.col("date") <= today).select("product_id"), "product_id", "left_anti")
        days = F.explode(F.sequence(F.date_add(today, 1), F.date_add(today, periods)))
        return fitted.unionByName(without.select(
            "product_id", days.alias("ds"), zero.alias("yhat"), zero.alias("lower"),
            zero.alias("upper"), F.lit("no_sales").alias("method")))
    if method != "moving_average":
        raise ValueError(f"unknown method {method!r}")
    today = resolve_as_of(sales, as_of)
    inside = (F.col("date") > F.date_sub(today, window)) & (F.col("date") <= today)
    units = F.when(inside, F.col("quantity")).otherwise(0)
    sums = sales.groupBy("product_id").agg(
        F.sum(units).alias("_units"), F.sum(units * units).alias("_squares"))
    mean = F.col("_units").cast("double") / window
    spread = F.col("_squares").cast("double") / window - mean * mean
    level = sums.select("product_id", today.alias("_last"), mean.alias("yhat"),
                        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("_std"))
    return _spread(level, periods, ["product_id"])


def revenue_forecast(sales: DataFrame, periods: int = 30, product: str | None = None,
                     by: str = "product_name") -> DataFrame:
    """Daily revenue ahead, of everything or of one product; 7 to 90 days.

    ``sales`` is at any grain with ``date`` and ``revenue`` (and ``by`` to filter).
    """
    if not 7 <= periods <= 90:
        raise ValueError("periods must lie between 7 and 90")
    if product is not None:
        sales = sales.filter(F.col(by) == product)
    daily = sales.groupBy("date").agg(F.sum("revenue").alias("revenue"))
    return seasonal_forecast(daily, "revenue", periods)


def forecast_vs_actual(forecast: DataFrame, daily: DataFrame, value: str, n: int = 30,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Mean forecast and interval against the mean of the last ``n`` actual rows."""
    ahead = forecast.groupBy(*keys).agg(
        F.avg("yhat").alias("forecast_mean"), F.avg("lower").alias("lower_mean"),
        F.avg("upper").alias("upper_mean"))
    actual = trailing_rows(daily, n, keys=keys).groupBy(*keys).agg(
        mean_of(value).alias("actual_mean"))
    if keys:
        both = ahead.join(actual, list(keys))
    else:
        both = ahead.withColumn("actual_mean", actual.scalar())
    return both.withColumn("delta", F.col("forecast_mean") - F.col("actual_mean"))


# -- forecasts against the days that followed ------------------------------------------


def rolling_origins(daily: DataFrame, value: str, method: str = "moving_average",
                    keys: Sequence[str] = (), horizon: int = 30, origins: int = 6,
                    step: int = 30, window: int = 30, history: int | None = None,
                    as_of=None) -> DataFrame:
    """Forecasts as they would have been made at several past days: one fit a series and origin.

    The origins lie ``step`` days apart, the last one ``horizon`` days before ``as_of``
    (default: the last date), and see the rows up to themselves (of ``history`` days, if
    given). Columns: key..., ``origin, ds, step`` (days ahead), ``yhat, lower, upper``.
    A series without a row up to an origin has no forecast there. Every row is
    copied to the origins that see it, so ``origins`` times ``history`` bounds the work.
    """
    if "origin" in keys:
        raise ValueError("a key must not be named origin")
    today = resolve_as_of(daily, as_of)
    ends = F.array(*[F.date_sub(today, horizon + i * step) for i in range(origins)])
    seen = daily.select(*keys, "date", value, F.explode(ends).alias("origin"))
    seen = seen.where(F.col("date") <= F.col("origin"))
    if history:
        seen = seen.where(F.col("date") > F.date_sub("origin", history))
    series = [*keys, "origin"]
    if method == "moving_average":
        recent = with_age(seen, window, keys=series)
        level = recent.groupBy(*series).agg(
            mean_of(value).alias("yhat"),
            F.stddev_pop(F.col(value).cast("double")).alias("_std"))
        ahead = _spread(level.withColumn("_last", F.col("origin")), horizon, series)
    elif method in ("holt_winters", "seasonal"):
        fit = holt_winters if method == "holt_winters" else seasonal_forecast
        ahead = fit(seen, value, horizon, keys=series, until=F.col("origin")).drop("method")
    else:
        raise ValueError(f"unknown method {method!r}")
    return ahead.withColumn("step", F.datediff("ds", "origin"))


def on_days(forecast: DataFrame, daily: DataFrame, value: str, keys: Sequence[str] = (),
            missing: float | None = 0.0) -> DataFrame:
    """Every forecast day with what was realised on it: a left join on key and date.

    ``actual`` is the value of that day; a day within the table's dates without a row
    counts ``missing``, a later one is null. ``inside``: within the interval.
    """
    last = daily.agg(F.max("date").alias("d")).scalar()
    realised = daily.select(*keys, F.col("date").alias("ds"), F.col(value).cast("double").alias("actual"))
    both = forecast.join(realised, [*keys, "ds"], "left")
    if missing is not None:
        both = both.withColumn("actual", F.when(
            F.col("ds") <= last, F.coalesce("actual", F.lit(missing))))
    return both.withColumn("inside", F.col("actual").between(F.col("lower"), F.col("upper")))


def error_measures(compared: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Errors of the days that have been realised, by days ahead or any other columns.

    ``bias`` is the mean of forecast less actual, ``mae`` and ``rmse`` its size,
    ``wape`` the sum of absolute errors in percent of the sum of absolute actuals (null
    if that is 0), ``coverage`` the share of days inside the interval.
    """
    error = F.col("yhat") - F.col("actual")
    return compared.where(F.col("actual").isNotNull() & F.col("yhat").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_days"), F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.try_divide(F.sum(F.abs(error)), F.sum(F.abs("actual"))) * 100).alias("wape"),
        F.avg(F.col("inside").cast("double")).alias("coverage"))

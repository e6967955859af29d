"""Row-position and calendar views of day-grain series.

Input is one row per date (and per key). Without ``keys`` there is one series;
its windows carry no partition and are bounded by the number of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from merchlight.functions.measures import (
    by_keys, change_pct, display_name, mean_of, mean_over, raw_change_pct, ratio,
    resolve_as_of)


def trailing_rows(df: DataFrame, n: int, order: str = "date",
                  keys: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows by ``order``, per key if keys are given."""
    if not keys:
        return df.orderBy(F.desc(order)).limit(n)
    age = F.row_number().over(by_keys(keys).orderBy(F.desc(order)))
    return df.withColumn("_age", age).filter(F.col("_age") <= n).drop("_age")


def with_age(df: DataFrame, n: int, order: str = "date",
             keys: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows with ``_age`` (1 = newest)."""
    if not keys:
        df = trailing_rows(df, n, order)
    age = F.row_number().over(by_keys(keys).orderBy(F.desc(order)))
    return df.withColumn("_age", age).filter(F.col("_age") <= n)


def since(df: DataFrame, as_of: Column, days: int, until: int | None = None,
          date: str = "date") -> DataFrame:
    """Rows with ``as_of - days <= date``; ``until`` adds ``date < as_of - until``."""
    rows = df.filter(F.col(date) >= F.date_sub(as_of, days))
    if until is None:
        return rows.filter(F.col(date) <= as_of)
    return rows.filter(F.col(date) < F.date_sub(as_of, until))


def period_sides(df: DataFrame, period: int, keys: Sequence[str] = (),
                 order: str = "date", short: str = "overlap") -> DataFrame:
    """The trailing rows that a period comparison needs, flagged by side.

    ``_recent`` marks the last ``period`` rows, ``_previous`` the ``period`` rows
    before. With a short history, ``overlap`` takes the first ``period`` of the
    rows that exist (they may overlap the recent ones); ``same`` compares the
    recent rows with themselves unless there are more than ``2 * period`` rows.
    """
    rows = with_age(df, 2 * period + 1, order, keys)
    age, seen = F.col("_age"), F.max("_age").over(by_keys(keys))
    recent = age <= period
    if short == "overlap":
        span = F.least(seen, F.lit(2 * period))
        previous = (age > span - period) & (age <= span)
    elif short == "same":
        previous = F.when(seen > 2 * period, age.between(period + 1, 2 * period)) \
                    .otherwise(recent)
    else:
        raise ValueError("short must be 'overlap' or 'same'")
    return rows.withColumns({"_recent": recent, "_previous": previous})


def period_over_period(daily: DataFrame, value: str, period: int = 30,
                       keys: Sequence[str] = (), order: str = "date",
                       short: str = "overlap") -> DataFrame:
    """Mean of the last rows against the mean of the rows before, and the change."""
    sides = period_sides(daily, period, keys, order, short)
    means = sides.groupBy(*keys).agg(
        mean_of(value, F.col("_recent")).alias("recent_mean"),
        mean_of(value, F.col("_previous")).alias("previous_mean"))
    return means.withColumn("change_pct", change_pct("recent_mean", "previous_mean"))


def sales_drop(daily: DataFrame, value: str = "total_sales", revenue: str = "revenue",
               threshold: float = -15.0, period: int = 30, keys: Sequence[str] = (),
               order: str = "date", short: str = "overlap") -> DataFrame:
    """Period comparison with a drop flag (strictly below the threshold) and the
    revenue put at risk: ``|change| / 100`` of the mean recent revenue."""
    sides = period_sides(daily, period, keys, order, short)
    out = sides.groupBy(*keys).agg(
        mean_of(value, F.col("_recent")).alias("recent_mean"),
        mean_of(value, F.col("_previous")).alias("previous_mean"),
        mean_of(revenue, F.col("_recent")).alias("mean_revenue"))
    out = out.withColumn("change_pct", change_pct("recent_mean", "previous_mean"))
    return out.withColumns({
        "is_drop": F.col("change_pct") < threshold,
        "lost_revenue": F.abs(F.col("change_pct") / 100) * F.col("mean_revenue"),
    }).drop("mean_revenue")


def day_over_day(daily: DataFrame, value: str, keys: Sequence[str] = (),
                 order: str = "date", name: str = "change_pct") -> DataFrame:
    """Change against the row before; null on the first row and after a zero."""
    before = F.lag(value).over(by_keys(keys).orderBy(order))
    return daily.withColumn(name, raw_change_pct(F.col(value), before))


def moving_average(daily: DataFrame, value: str, window: int = 7,
                   keys: Sequence[str] = (), order: str = "date",
                   name: str = "moving_average") -> DataFrame:
    """Mean of this row and the ``window - 1`` rows before it."""
    frame = by_keys(keys).orderBy(order).rowsBetween(1 - window, 0)
    return daily.withColumn(name, mean_over(value, frame))


def category_columns(df: DataFrame, total: str = "total_sales") -> list[str]:
    """Category columns by name: they contain ``sales`` and are not the total."""
    return [c for c in df.columns if "sales" in c and c != total]


def unpivot_categories(daily_wide: DataFrame, date: str = "date",
                       keys: Sequence[str] = ()) -> DataFrame:
    """Wide daily table to (date, category, sales), with the column position.

    The rows are exploded from an array of structs, so that names and positions
    are constants of the plan rather than string work per row.
    """
    items = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).cast("double").alias("sales"),
                 F.lit(i).alias("category_order"), display_name(F.lit(c)).alias("display_name"))
        for i, c in enumerate(category_columns(daily_wide), start=1)])
    return daily_wide.select(*keys, date, F.explode(items).alias("c")) \
                     .select(*keys, date, "c.*")


def daily_wide(daily_long: DataFrame, categories: Sequence[str] | None = None,
               date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """(date, category, sales) to one column ``<category>_sales`` per category."""
    grouped = daily_long.groupBy(*keys, date)
    wide = grouped.pivot("category", list(categories)) if categories \
        else grouped.pivot("category")
    wide = wide.agg(F.sum("sales"))
    names = [c for c in wide.columns if c not in (*keys, date)]
    return wide.select(*keys, date, *[
        F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
         .alias(f"{c.strip().lower().replace(' ', '_')}_sales") for c in names])


def category_means(daily: DataFrame, n: int = 7, order: str = "date",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Mean daily sales of each category over the last ``n`` rows."""
    long = unpivot_categories(trailing_rows(daily, n, order, keys), order, keys)
    return long.groupBy(*keys, "category", "display_name", "category_order") \
               .agg(mean_of("sales").alias("mean_sales"))


def top_categories(daily: DataFrame, n: int = 3, order: str = "date",
                   keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` best categories on the newest row; ties keep column order."""
    long = unpivot_categories(trailing_rows(daily, 1, order, keys), order, keys)
    best = by_keys(keys).orderBy(F.desc("sales"), "category_order")
    return long.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def metric_correlation(daily: DataFrame, a: str, b: str,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation over rows that have both values; null if one is constant."""
    rows = daily.select(*keys, F.col(a).cast("double").alias("_a"),
                        F.col(b).cast("double").alias("_b")).dropna(subset=["_a", "_b"])
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_days"),
        ratio(F.covar_pop("_a", "_b"),
              F.stddev_pop("_a") * F.stddev_pop("_b")).alias("correlation"))

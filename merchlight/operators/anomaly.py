"""Outlier days: z-scores per series, features for the forest, and alert union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from merchlight.functions.measures import by_keys, mean_over, ratio
from merchlight.operators.isolation_forest import isolation_forest
from merchlight.operators.trend import day_over_day, moving_average, trailing_rows

REVENUE_FEATURES = ["daily_revenue", "order_count", "moving_average", "change_pct"]


def severity(z_score: Column) -> Column:
    """Steps of ours: critical from 5 deviations, high from 4, else medium."""
    size = F.abs(z_score)
    return F.when(size >= 5, "critical").when(size >= 4, "high").otherwise("medium")


def zscores(daily: DataFrame, value: str, keys: Sequence[str] = (),
            z: float = 3.0) -> DataFrame:
    """Each row with its series mean, z-score (population deviation) and flag.

    A constant series has null scores and no flags.
    """
    series = by_keys(keys)
    number = F.col(value).cast("double")
    scored = daily.withColumns({
        "expected": mean_over(value, series),
        "_std": F.stddev_pop(number).over(series)})
    score = ratio(number - F.col("expected"), F.col("_std"))
    return scored.withColumn("z_score", score).withColumn(
        "is_anomaly", F.coalesce(F.abs(F.col("z_score")) > z, F.lit(False))).drop("_std")


def zscore_anomalies(daily: DataFrame, value: str, keys: Sequence[str] = (),
                     z: float = 3.0) -> DataFrame:
    """Flagged rows as records: date, expected, actual, score, severity."""
    flagged = zscores(daily, value, keys, z).filter("is_anomaly")
    return flagged.select(
        "date", *keys, F.col("expected").alias("expected_sales"),
        F.col(value).cast("double").alias("actual_sales"), "z_score",
        severity(F.col("z_score")).alias("severity"))


def recent_anomalies(scored: DataFrame, n: int = 7, order: str = "date",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Flagged rows among the last ``n`` rows."""
    return trailing_rows(scored, n, order, keys).filter("is_anomaly")


def revenue_features(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Daily revenue, order count, 7-day moving average and day-over-day change."""
    base = daily.select(*keys, "date", F.col("orders").alias("order_count"), "revenue")
    wide = moving_average(day_over_day(base, "revenue", keys), "revenue", 7, keys)
    return wide.select(
        *keys, "date", F.col("revenue").cast("double").alias("daily_revenue"),
        F.col("order_count").cast("double").alias("order_count"), "moving_average",
        F.coalesce("change_pct", F.lit(0.0)).alias("change_pct"))


def revenue_anomalies(daily: DataFrame, contamination: float = 0.05,
                      seed: int = 42) -> DataFrame:
    """Forest outliers over the revenue features, as spikes or drops against the
    moving average."""
    scored = isolation_forest(revenue_features(daily), REVENUE_FEATURES, ["date"],
                              contamination=contamination, seed=seed)
    kind = F.when(F.col("daily_revenue") >= F.col("moving_average"), "spike") \
            .otherwise("drop")
    return scored.filter("is_anomaly").withColumn("kind", kind)


def unified_alerts(*alerts: DataFrame) -> DataFrame:
    """One table from several detectors; columns a detector lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alerts)

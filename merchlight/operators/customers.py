"""Customer segments from recency, frequency and monetary value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchlight.functions.measures import resolve_as_of
from merchlight.functions.quantiles import exact_quantiles
from merchlight.session import stage

# Segment names by total score (3-9).
AT_RISK, LOYAL, CHAMPIONS = "At-Risk", "Loyal", "Champions"


def customer_rfm(orders: DataFrame, as_of=None) -> DataFrame:
    """Per customer: days since the last order, number of orders, revenue.

    ``orders`` holds one row per order.
    """
    today = resolve_as_of(orders, as_of)
    grouped = orders.groupBy("customer_id").agg(
        F.max("date").alias("last_date"),
        F.count("*").alias("frequency"),
        F.sum("revenue").alias("monetary"))
    return grouped.select(
        "customer_id", F.datediff(today, F.col("last_date")).alias("recency"),
        "frequency", F.col("monetary").cast("double").alias("monetary"))


def _tercile_score(value: str, cuts: list[float], low_is_good: bool = False) -> Column:
    first, second = cuts
    low, high = (3, 1) if low_is_good else (1, 3)
    return F.when(F.col(value) <= first, low).when(F.col(value) <= second, 2) \
            .otherwise(high)


def rfm_segments(orders: DataFrame, as_of=None) -> DataFrame:
    """R, F and M scored 1-3 at exact tercile cuts over all customers, and a segment.

    The per-customer table is written once and read by the cut-point passes and
    the scoring pass; the cuts are six numbers.
    """
    base = stage(customer_rfm(orders, as_of), "rfm")
    measures = ["recency", "frequency", "monetary"]
    cuts = exact_quantiles(base, measures, [1 / 3, 2 / 3])
    if cuts["recency"][0] is None:          # no customers
        cuts = {m: [0.0, 0.0] for m in measures}
    scored = base.withColumns({
        "r_score": _tercile_score("recency", cuts["recency"], low_is_good=True),
        "f_score": _tercile_score("frequency", cuts["frequency"]),
        "m_score": _tercile_score("monetary", cuts["monetary"])})
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return scored.withColumns({
        "rfm_score": total,
        "segment": F.when(total <= 4, AT_RISK).when(total <= 6, LOYAL)
                    .otherwise(CHAMPIONS)})


def rfm_summary(segments: DataFrame) -> DataFrame:
    """Customers, revenue and mean recency per segment."""
    amount = F.col("monetary").cast("decimal(28,4)")
    return segments.groupBy("segment").agg(
        F.count("*").alias("customers"), F.sum(amount).alias("revenue"),
        (F.sum("recency").cast("double") / F.count("*")).alias("mean_recency"))

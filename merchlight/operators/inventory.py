"""Stock positions, supply days, restock quantities and stock outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from merchlight.functions.measures import (
    as_column, days_of_supply, mean_of, ratio, resolve_as_of)
from merchlight.operators.trend import with_age
from merchlight.session import stage

# Class bounds in days of stock.
CRITICAL_DAYS, LOW_DAYS, OVERSTOCK_DAYS = 15, 20, 90

INT_RANGE = 2 ** 32


def latest_inventory(snapshots: DataFrame) -> DataFrame:
    """Newest count per product; of several counts at one time, the highest.

    The maximum of a struct can only be taken by sorting. For a date and an int
    count both fit one long (day in the high bits), whose maximum is a plain hash
    aggregate; other types take the struct.
    """
    kinds = {f.name: f.dataType for f in snapshots.schema}
    if isinstance(kinds["last_updated"], T.DateType) \
            and isinstance(kinds["quantity_on_hand"], T.IntegerType):
        count = F.col("quantity_on_hand").cast("bigint") + INT_RANGE // 2
        packed = F.unix_date("last_updated").cast("bigint") * INT_RANGE + count
        newest = snapshots.dropna(subset=["last_updated", "quantity_on_hand"]) \
                          .groupBy("product_id").agg(F.max(packed).alias("p"))
        return newest.select(
            "product_id",
            (F.pmod("p", F.lit(INT_RANGE)) - INT_RANGE // 2).cast("int")
            .alias("quantity_on_hand"),
            F.date_from_unix_date(F.shiftright("p", 32).cast("int"))
            .alias("last_updated"))
    newest = F.max(F.struct("last_updated", "quantity_on_hand"))
    return snapshots.dropna(subset=["last_updated", "quantity_on_hand"]) \
        .groupBy("product_id").agg(newest.alias("s")).select(
            "product_id", F.col("s.quantity_on_hand").alias("quantity_on_hand"),
            F.col("s.last_updated").alias("last_updated"))


def demand_rate(sales: DataFrame, as_of=None, window: int = 30) -> DataFrame:
    """Units sold in the last ``window`` dates and per day, for products with sales.

    Dates without a sale count as zero demand.
    """
    today = resolve_as_of(sales, as_of)
    recent = sales.filter((F.col("date") > F.date_sub(today, window))
                          & (F.col("date") <= today))
    return recent.groupBy("product_id").agg(
        F.sum("quantity").alias("recent_quantity")
    ).withColumn("daily_demand", F.col("recent_quantity").cast("double") / window)


def stock_position(products: DataFrame, inventory: DataFrame,
                   demand: DataFrame) -> DataFrame:
    """Every product with its stock and demand; missing ones count as zero.

    All three sides are keyed by product, so each is shuffled at most once.
    """
    joined = products.join(inventory, "product_id", "left") \
                     .join(demand, "product_id", "left")
    return joined.withColumns({
        "quantity_on_hand": F.coalesce("quantity_on_hand", F.lit(0)).cast("bigint"),
        "recent_quantity": F.coalesce("recent_quantity", F.lit(0)).cast("bigint"),
        "daily_demand": F.coalesce("daily_demand", F.lit(0.0))})


def risk_class(days: Column | str) -> Column:
    days = as_column(days)
    return F.when(days < CRITICAL_DAYS, "critical").when(days < LOW_DAYS, "low") \
            .when(days <= OVERSTOCK_DAYS, "healthy").otherwise("overstock")


def inventory_status(position: DataFrame) -> DataFrame:
    """Days of stock, risk class, and whether stock is below the reorder level."""
    days = days_of_supply("quantity_on_hand", "daily_demand")
    return position.withColumn("days_of_stock", days).withColumns({
        "risk": F.when(F.col("daily_demand") > 0, risk_class("days_of_stock"))
                 .otherwise("no_demand"),
        "below_reorder": F.col("quantity_on_hand") < F.col("reorder_level")})


def inventory_health(daily: DataFrame, n: int = 30, alert_below: float = LOW_DAYS,
                     keys: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Mean stock over mean sales of the last ``n`` rows, with an alert flag."""
    recent = with_age(daily, n, order, keys)
    means = recent.groupBy(*keys).agg(
        mean_of("inventory_level").alias("mean_inventory"),
        mean_of("total_sales").alias("mean_sales"))
    return means.withColumn(
        "days_of_supply", days_of_supply("mean_inventory", "mean_sales")
    ).withColumn("alert", F.col("days_of_supply") < alert_below)


def inventory_needs(position: DataFrame, periods: int = 30,
                    safety_days: int = 14) -> DataFrame:
    """Units to order: demand over the horizon plus safety days, less the stock."""
    horizon = periods + safety_days
    need = F.col("daily_demand") * horizon - F.col("quantity_on_hand")
    return position.withColumns({
        "expected_demand": F.col("daily_demand") * periods,
        "restock_quantity": F.greatest(F.lit(0), F.ceil(need)).cast("bigint")})


def project_stock(position: DataFrame, forecast: DataFrame,
                  in_transit: DataFrame | None = None) -> DataFrame:
    """Stock of every product day by day under a forecast: what arrives, sells and is missed.

    ``forecast`` has ``product_id, ds, yhat`` of any method, ``in_transit`` the
    ``product_id, ds, quantity`` of orders on their way. A day's arrivals come before
    its sales, and stock never falls below 0: what is missing is lost. The recurrence
    ``max(stock + arrivals - demand, 0)`` is the running sum less its lowest point below
    0 so far, so windows over a product's days say it. Products without a forecast
    have no row; negative and missing demand count 0.
    """
    demand = F.greatest(F.coalesce("yhat", F.lit(0.0)), F.lit(0.0))
    days = forecast.select("product_id", "ds", demand.alias("demand"))
    if in_transit is not None:
        coming = in_transit.groupBy("product_id", "ds").agg(F.sum("quantity").alias("arrivals"))
        days = days.join(coming, ["product_id", "ds"], "left")
    else:
        days = days.withColumn("arrivals", F.lit(0))
    days = days.withColumn("arrivals", F.coalesce(F.col("arrivals"), F.lit(0)).cast("bigint"))
    stock = F.greatest(F.coalesce("quantity_on_hand", F.lit(0)), F.lit(0))
    rows = days.join(position.select("product_id", stock.alias("_stock")), "product_id")
    until = W.partitionBy("product_id").orderBy("ds")
    free = F.col("_stock") + F.sum(F.col("arrivals") - F.col("demand")).over(until)
    rows = rows.withColumn("_free", free)
    lost = F.greatest(-F.min("_free").over(until), F.lit(0.0))
    rows = rows.withColumn("_lost", lost)
    return rows.select(
        "product_id", "ds", "demand", "arrivals", (F.col("_free") + F.col("_lost")).alias("stock"),
        (F.col("_lost") - F.coalesce(F.lag("_lost").over(until), F.lit(0.0))).alias("lost"))


def restock_plan(position: DataFrame, forecast: DataFrame, in_transit: DataFrame | None = None,
                 safety_days: int = 14, lead_days: int = 7) -> DataFrame:
    """What to order, and by when, from a day-by-day projection.

    The quantity covers the forecast demand and ``safety_days`` of its mean, less the
    stock and what arrives; under a flat forecast without orders in transit it is that of
    ``inventory_needs``. ``stock_out`` is the first day with lost sales, ``order_by`` the
    day ``lead_days`` before. Products without a forecast need nothing.
    """
    days = project_stock(position, forecast, in_transit)
    sums = days.groupBy("product_id").agg(
        F.sum("demand").alias("expected_demand"), F.avg("demand").alias("_mean"),
        F.sum("arrivals").alias("arrivals"), F.sum("lost").alias("lost_demand"),
        F.min("stock").alias("lowest_stock"),
        F.min(F.when(F.col("lost") > 1e-6, F.col("ds"))).alias("stock_out"))
    need = F.col("expected_demand") + F.col("_mean") * safety_days - F.col("arrivals") \
        - F.col("quantity_on_hand")
    zero = F.lit(0.0)
    return position.select("product_id", F.coalesce("quantity_on_hand", F.lit(0)).cast("bigint")
                           .alias("quantity_on_hand")).join(sums, "product_id", "left").select(
        "product_id", "quantity_on_hand", F.coalesce("arrivals", F.lit(0)).alias("arrivals"),
        *[F.coalesce(c, zero).alias(c) for c in ("expected_demand", "lost_demand")],
        F.coalesce("lowest_stock", F.greatest("quantity_on_hand", F.lit(0)).cast("double"))
        .alias("lowest_stock"), "stock_out", F.date_sub("stock_out", lead_days).alias("order_by"),
        F.greatest(F.lit(0), F.ceil(F.round(F.coalesce(need, zero), 6))).cast("bigint")
        .alias("restock_quantity"))


def restock_list(position: DataFrame, periods: int = 30, safety_days: int = 14,
                 below: float = LOW_DAYS) -> DataFrame:
    """Products that run out soon or sit below their reorder level, most urgent first."""
    status = inventory_needs(inventory_status(position), periods, safety_days)
    urgent = status.filter((F.col("restock_quantity") > 0)
                           & ((F.col("days_of_stock") < below) | F.col("below_reorder")))
    urgency = F.when(F.col("days_of_stock") < CRITICAL_DAYS, "critical") \
               .when(F.col("days_of_stock") < below, "low").otherwise("reorder")
    return urgent.withColumn("urgency", urgency).orderBy("days_of_stock", "product_id")


def inventory_anomalies(status: DataFrame, z: float = 3.0) -> DataFrame:
    """Products whose days of stock lie far from the mean, or that may run out.

    Mean and deviation run over products with demand; the status table is
    written once because it is read by the statistics and by the flags.
    """
    stored = stage(status.filter(F.col("daily_demand") > 0), "stock-status")
    stats = stored.agg(F.avg("days_of_stock").alias("mean"),
                       F.stddev_pop("days_of_stock").alias("std"))
    moments = stats.select(F.struct("mean", "std")).scalar()
    scored = stored.withColumn(
        "z_score", ratio(F.col("days_of_stock") - moments["mean"], moments["std"]))
    kind = F.when(F.col("z_score") > z, "excess_stock") \
            .when(F.col("z_score") < -z, "low_stock") \
            .when(F.col("risk") == "critical", "stock_out_risk")
    return scored.withColumns({"anomaly_type": kind, "expected_days": moments["mean"]}) \
                 .filter(F.col("anomaly_type").isNotNull())

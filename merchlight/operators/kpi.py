"""Totals, rankings and breakdowns over sales at any additive grain.

``sales`` carries ``date, sale_rows, quantity, revenue`` and may be one row per
sale line, per order or per day: the sums are the same, so callers hand in the
cheapest grain. ``products`` carries one row per product with its totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from merchlight.functions.measures import (
    COST_RATIO, change_pct, days_of_supply, display_name, mean_of, money, ratio,
    raw_change_pct, resolve_as_of)
from merchlight.operators.trend import category_columns, period_sides, since


def with_profit(df: DataFrame, revenue: str = "revenue",
                cost_ratio: float = COST_RATIO) -> DataFrame:
    """Cost as a share of revenue, profit, and margin in percent."""
    amount = F.col(revenue).cast("double")
    cost = amount * cost_ratio
    return df.withColumns({
        "cost": cost,
        "profit": amount - cost,
        "profit_margin": ratio(amount - cost, amount) * 100})


def _recent_previous(as_of: Column, days: int) -> dict[str, Column]:
    """Calendar windows: recent is [as_of - days, as_of], previous the ``days`` before."""
    date, start = F.col("date"), F.date_sub(as_of, days)
    return {"recent": (date >= start) & (date <= as_of),
            "previous": (date < start) & (date >= F.date_sub(as_of, 2 * days))}


def _totals(sales: DataFrame, as_of, days: int) -> DataFrame:
    """All additive KPI inputs in one conditional aggregate."""
    part = _recent_previous(resolve_as_of(sales, as_of), days)
    zero = F.lit(0).cast("decimal(38,4)")

    def total(where=None):
        amount = F.col("revenue") if where is None else F.when(where, F.col("revenue"))
        return F.coalesce(F.sum(amount).cast("decimal(38,4)"), zero)

    return sales.agg(
        total().alias("total"),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("quantity"),
        F.coalesce(F.sum("sale_rows"), F.lit(0)).cast("bigint").alias("sale_rows"),
        total(part["recent"]).alias("recent"),
        total(part["previous"]).alias("previous"))


def _growth() -> Column:
    return F.when(F.col("previous") > 0, change_pct("recent", "previous")).otherwise(0.0)


def top_products(products: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` products with the highest revenue; ties go to the lower id."""
    return products.orderBy(F.desc("revenue"), "product_id").limit(n)


def kpi_summary(sales: DataFrame, products: DataFrame, as_of=None,
                days: int = 30) -> DataFrame:
    """Total revenue and quantity, mean sale value, best product, calendar growth."""
    best = top_products(products, 1).select("product_name").scalar()
    return _totals(sales, as_of, days).select(
        money("total").alias("total_revenue"),
        F.col("quantity").alias("total_sales_quantity"),
        F.round(F.coalesce(ratio("total", "sale_rows"), F.lit(0.0)), 2)
         .alias("avg_order_value"),
        F.coalesce(best, F.lit("N/A")).alias("top_product"),
        F.round(_growth(), 2).alias("revenue_growth_pct"))


def business_context(sales: DataFrame, products: DataFrame, as_of=None, days: int = 30,
                     top: int = 5, extra: Mapping[str, str] | None = None) -> DataFrame:
    """One row of context: totals, calendar change, recent share, best products.

    ``top_products`` is an array of (rank, product_id, name, revenue), best first;
    ``extra`` adds free-form text entries as a map.
    """
    item = F.struct(F.col("rank"), F.col("product_id"),
                    F.col("product_name").alias("name"), money("revenue").alias("revenue"))
    best = top_products(products, top).withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc("revenue"), "product_id")))
    listed = best.agg(F.sort_array(F.collect_list(item)).alias("items")).scalar()
    context = _totals(sales, as_of, days).select(
        money("total").alias("total_revenue"),
        F.col("sale_rows").alias("total_sales_orders"),
        money("recent").alias("recent_revenue"),
        money("previous").alias("previous_revenue"),
        F.round(_growth(), 4).alias("revenue_change_pct"),
        F.round(ratio("recent", F.greatest(F.col("total"), F.lit(1))) * 100, 4)
         .alias("recent_share_pct"),
        listed.alias("top_products"))
    if extra:
        pairs = [F.lit(str(x)) for kv in extra.items() for x in kv]
        context = context.withColumn("extra", F.create_map(*pairs))
    return context


def sales_trend(sales: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """Revenue and quantity per date since ``as_of - days``, in date order."""
    recent = since(sales, resolve_as_of(sales, as_of), days)
    return recent.groupBy("date").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity")
    ).orderBy("date")


def monthly_revenue(sales: DataFrame, cost_ratio: float = COST_RATIO) -> DataFrame:
    """Revenue, profit, quantity and sale rows per calendar month."""
    monthly = sales.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"),
        F.sum("sale_rows").alias("sale_rows"))
    return with_profit(monthly, cost_ratio=cost_ratio).orderBy("month")


def revenue_breakdown(sales: DataFrame, by: str,
                      cost_ratio: float = COST_RATIO) -> DataFrame:
    """Revenue, profit, margin and share of the total per value of a dimension."""
    grouped = sales.groupBy(by).agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"),
        F.sum("sale_rows").alias("sale_rows"))
    # one row per dimension value from here on
    share = ratio("revenue", F.sum("revenue").over(W.partitionBy())) * 100
    return with_profit(grouped, cost_ratio=cost_ratio).withColumn("share_pct", share)


def revenue_by_region(sales: DataFrame) -> DataFrame:
    return revenue_breakdown(sales, "region")


def revenue_by_category(sales: DataFrame) -> DataFrame:
    return revenue_breakdown(sales, "category")


def dataset_stats(sales: DataFrame, products: DataFrame,
                  approx: bool = False) -> DataFrame:
    """Row count, date range, distinct products and customers.

    ``sales`` carries customer ids, ``products`` product ids; they may be the
    same frame. ``approx`` swaps the exact distinct counts for sketches.
    """
    distinct = F.approx_count_distinct if approx else F.count_distinct
    n_products = products.agg(distinct(F.col("product_id")).alias("n")).scalar()
    return sales.agg(
        F.sum("sale_rows").cast("bigint").alias("sale_rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        distinct(F.col("customer_id")).alias("customers"),
    ).withColumn("products", n_products)


def business_snapshot(daily: DataFrame, keys: Sequence[str] = (), period: int = 30,
                      week: int = 7, threshold: float = -15.0, order: str = "date",
                      short: str = "overlap") -> DataFrame:
    """Everything the cards, rules and answers read, in one aggregate per series.

    ``daily`` has ``date, total_sales, revenue, inventory_level``, optionally
    ``customers`` and category columns. Only the last ``2 * period + 1`` rows of a
    series are looked at.
    """
    sides = period_sides(daily, period, keys, order, short)
    age, recent = F.col("_age"), F.col("_recent")

    def at(n, column):
        return F.max(F.when(age == n, F.col(column)))

    aggs = [
        at(1, order).alias("as_of"),
        at(1, "total_sales").alias("latest_sales"),
        at(2, "total_sales").alias("day_before_sales"),
        at(1, "inventory_level").alias("latest_inventory"),
        at(2, "inventory_level").alias("day_before_inventory"),
        F.sum(F.when(recent, F.col("revenue"))).alias("revenue_recent"),
        mean_of("revenue", recent).alias("mean_revenue"),
        mean_of("total_sales", recent).alias("recent_mean"),
        mean_of("total_sales", F.col("_previous")).alias("previous_mean"),
        mean_of("inventory_level", recent).alias("mean_inventory"),
    ]
    if "customers" in daily.columns:
        aggs.append(mean_of("customers", age <= week).alias("mean_customers"))
    ranked = [F.struct((-F.col(c).cast("double")).alias("k"), F.lit(i).alias("position"),
                       F.lit(c).alias("category"), display_name(F.lit(c)).alias("name"),
                       F.col(c).cast("double").alias("sales"))
              for i, c in enumerate(category_columns(daily))]
    if ranked:
        newest = F.max(F.when(age == 1, F.sort_array(F.array(*ranked))))
        aggs.append(F.transform(newest, lambda x: F.struct(
            x["category"].alias("category"), x["name"].alias("name"),
            x["sales"].alias("sales"))).alias("top_categories"))

    out = sides.groupBy(*keys).agg(*aggs)
    change = change_pct("recent_mean", "previous_mean")
    return out.withColumns({
        "sales_day_change_pct": raw_change_pct("latest_sales", "day_before_sales"),
        "inventory_day_change_pct":
            raw_change_pct("latest_inventory", "day_before_inventory"),
        "change_pct": change,
        "is_drop": change < threshold,
        "lost_revenue": F.abs(change / 100) * F.col("mean_revenue"),
        "days_of_supply": days_of_supply("mean_inventory", "recent_mean"),
    })


def kpi_cards(daily: DataFrame, keys: Sequence[str] = (), period: int = 30,
              week: int = 7) -> DataFrame:
    """Newest day with its day-over-day change, revenue of the last ``period`` rows
    and mean customers of the last ``week`` rows."""
    state = business_snapshot(daily, keys, period, week)
    return state.select(*keys, "as_of", "latest_sales", "sales_day_change_pct",
                        "latest_inventory", "inventory_day_change_pct",
                        "revenue_recent", "mean_customers")

"""Rule-based recommendations in one schema: type, title, description, impact,
action_items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from merchlight.functions.measures import fixed_text, ratio
from merchlight.functions.quantiles import exact_quantiles
from merchlight.operators.customers import AT_RISK, CHAMPIONS, LOYAL
from merchlight.operators.inventory import LOW_DAYS, OVERSTOCK_DAYS
from merchlight.session import stage

# Price steps in percent, and the share of customers that a
# retention campaign addresses first.
PRICE_RAISE, PRICE_CUT = 5, -10
TOP_CUSTOMER_SHARE = 0.2

RECOMMENDATION_COLUMNS = ["type", "title", "description", "impact", "action_items"]


def _advice(kind: str, title, description, impact: str, *actions: str) -> Column:
    def text(x):
        return F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(kind).alias("type"), text(title).alias("title"),
        text(description).alias("description"), F.lit(impact).alias("impact"),
        F.array(*[F.lit(a) for a in actions]).alias("action_items"))


def recommendations(snapshot: DataFrame, keys: Sequence[str] = (),
                    top: int = 2) -> DataFrame:
    """Stock, drop and top-category advice per series; a default when none applies.

    ``snapshot`` is a business snapshot: one row per series, so the rules are
    columns and their rows an explode, without further joins.
    """
    days, change = F.col("days_of_supply"), F.col("change_pct")
    none = F.lit(None)
    restock = _advice("restock", "Restock soon",
                      F.concat(F.lit("Stock covers "), fixed_text(days, 1),
                               F.lit(" days of sales")),
                      "high", "Order the fastest sellers", "Confirm supplier lead times")
    reduce_stock = _advice("inventory", "Release tied-up stock",
                           F.concat(F.lit("Stock covers "), fixed_text(days, 1),
                                    F.lit(" days of sales")),
                           "medium", "Pause reorders", "Clear slow items")
    promote = _advice("promotion", "Win back sales",
                      F.concat(F.lit("Sales changed by "), fixed_text(change, 1),
                               F.lit(" percent")),
                      "high", "Plan a promotion", "Check supply of key items")
    default = _advice("status", "Stay on course", "All measures are within bounds", "low",
                      "Keep the current plan")
    rules = F.array(
        F.when(days < LOW_DAYS, restock).when(days > OVERSTOCK_DAYS, reduce_stock)
         .otherwise(none),
        F.when(F.col("is_drop"), promote).otherwise(none))
    best = F.transform(
        F.slice(F.col("top_categories"), 1, top),
        lambda c: _advice("category", F.concat(F.lit("Back "), c["name"]),
                          F.concat(c["name"], F.lit(" sold "), fixed_text(c["sales"], 0),
                                   F.lit(" on the newest day")),
                          "medium", "Keep it in stock", "Feature it in marketing"))
    fired = F.array_compact(F.concat(rules, F.coalesce(best, F.array())))
    chosen = F.when(F.size(fired) > 0, fired).otherwise(F.array(default))
    return snapshot.select(*keys, F.explode(chosen).alias("r")).select(*keys, "r.*")


def action_plan(snapshot: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Three decisions per series (stock, sales, focus) with the number behind each."""
    low = F.col("days_of_supply") < LOW_DAYS
    best = F.col("top_categories")[0]
    rows = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("stock").alias("topic"),
                 F.when(low, "urgent_restock").otherwise("hold").alias("decision"),
                 F.when(low, best["name"]).alias("target"),
                 F.col("days_of_supply").alias("measure")),
        F.struct(F.lit(2).alias("step"), F.lit("sales").alias("topic"),
                 F.when(F.col("is_drop"), "recovery").otherwise("growth").alias("decision"),
                 F.lit(None).cast("string").alias("target"),
                 F.col("change_pct").alias("measure")),
        F.struct(F.lit(3).alias("step"), F.lit("focus").alias("topic"),
                 F.lit("promote_best").alias("decision"), best["name"].alias("target"),
                 best["sales"].alias("measure")))
    return snapshot.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def pricing_suggestions(products: DataFrame, high_share: float = 0.8,
                        slow_share: float = 0.2) -> DataFrame:
    """Price steps per product: up where the unit profit is high, down where units
    sold are few (this one wins when both hold).

    Cut points are exact quantiles over all products: at or above ``high_share``
    of unit profit, at or below ``slow_share`` of units. A product that never sold has 0
    units and no unit revenue: a slow mover without a suggested price.
    """
    # profit follows from the cost ratio, so its rank is that of the unit price
    measured = products.select(
        "product_id", "product_name", "category", F.col("quantity").alias("units"),
        ratio("revenue", "quantity").alias("unit_revenue"))
    stored = stage(measured, "pricing")
    cuts = exact_quantiles(stored, ["unit_revenue", "units"], [high_share, slow_share])
    cuts_high, cuts_slow = cuts["unit_revenue"][0], cuts["units"][1]
    slow = F.col("units") <= F.lit(cuts_slow)
    high = F.col("unit_revenue") >= F.lit(cuts_high)
    step = F.when(slow, PRICE_CUT).when(high, PRICE_RAISE)
    reason = F.when(slow, "slow_mover").when(high, "high_margin")
    new_price = F.col("unit_revenue") * (1 + F.col("price_change_pct") / 100.0)
    return stored.withColumns({"price_change_pct": step, "reason": reason}) \
                 .filter(F.col("reason").isNotNull()) \
                 .withColumn("suggested_price", new_price)


def retention_actions(segments: DataFrame, top_share: float = TOP_CUSTOMER_SHARE
                      ) -> DataFrame:
    """One action per customer by segment; the best ``top_share`` by revenue first.

    ``segments`` is the outcome of ``rfm_segments``: a projection of a stored table,
    so reading it for the cut and again for the actions repeats no aggregation.
    """
    stored = segments.select("customer_id", "segment", "recency", "frequency", "monetary")
    cut = exact_quantiles(stored, ["monetary"], [1 - top_share])["monetary"][0]
    top = F.coalesce(F.col("monetary") >= F.lit(cut), F.lit(False))
    segment = F.col("segment")
    action = F.when(segment == AT_RISK, "win_back_offer") \
              .when(segment == LOYAL, "loyalty_points").otherwise("early_access")
    priority = F.when(top & (segment != CHAMPIONS), "high") \
                .when(segment == AT_RISK, "medium").otherwise("low")
    return stored.withColumns({"is_top_customer": top, "action": action,
                               "priority": priority})


def restock_advice(restock: DataFrame) -> DataFrame:
    row = _advice(
        "restock", F.concat(F.lit("Reorder "), F.col("product_name")),
        F.concat(F.lit("Product "), F.col("product_id").cast("string"), F.lit(": order "),
                 F.col("restock_quantity").cast("string"), F.lit(" units")),
        "high", "Place the order", "Watch daily demand")
    return restock.select(row.alias("r")).select("r.*")


def pricing_advice(pricing: DataFrame) -> DataFrame:
    row = _advice(
        "pricing", F.concat(F.lit("Reprice "), F.col("product_name")),
        F.concat(F.lit("Product "), F.col("product_id").cast("string"),
                 F.lit(": change by "), F.col("price_change_pct").cast("string"),
                 F.lit(" percent")),
        "medium", "Test the new price", "Review units sold")
    return pricing.select(row.alias("r")).select("r.*")


def retention_advice(retention: DataFrame) -> DataFrame:
    """Customers that need attention: every action of high or medium priority."""
    row = _advice(
        "retention", F.concat(F.lit("Keep "), F.col("segment"), F.lit(" customer")),
        F.concat(F.lit("Customer "), F.col("customer_id").cast("string"), F.lit(": "),
                 F.col("action")),
        "medium", "Contact the customer", "Track the next order")
    return retention.filter(F.col("priority") != "low").select(row.alias("r")).select("r.*")


def all_recommendations(*parts: DataFrame) -> DataFrame:
    """Every recommendation source in the one schema."""
    same = [p.select(*RECOMMENDATION_COLUMNS) for p in parts]
    return reduce(DataFrame.unionByName, same)

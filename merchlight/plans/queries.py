"""The registered queries: operators assembled over the star tables.

Each takes a ``SalesModel`` and returns a DataFrame. Money leaves as double
rounded to cents, other measures rounded to a few decimals, so that results
compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchlight.functions.measures import money
from merchlight.operators import (
    advise, anomaly, customers, forecast, inventory, kpi, questions, trend)
from merchlight.operators.isolation_forest import (
    isolation_forest, isolation_forest_by_key)
from merchlight.plans.model import CATEGORIES, SalesModel
from merchlight.session import new_path, stage
from merchlight.sources import csv, sinks
from merchlight.streaming import alerts, stock

QUERIES: dict[str, Callable[[SalesModel], DataFrame]] = {}
#: Newest rows that a comparison of two periods of 30 looks at.
SIDES = 61


def query(fn: Callable[[SalesModel], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def run(name: str, spark: SparkSession, root: str) -> DataFrame:
    return QUERIES[name](SalesModel(spark, root))


def rounded(digits: int, *names: str) -> dict[str, Column]:
    return {n: F.round(F.col(n).cast("double"), digits) for n in names}


# -- sources and projections --------------------------------------------------------


@query
def sales_fact(m):
    return m.sales_fact().withColumn("revenue", F.col("revenue").cast("double"))


@query
def unmatched_lines(m):
    return m.unmatched_lines().withColumn("revenue", money("revenue"))


@query
def validate_sales(m):
    """The fact as raw text, coerced and checked; rows and revenue per outcome."""
    columns = csv.SALES_COLUMNS
    raw = m.sales_fact().select(*[F.col(c).cast("string").alias(c) for c in columns])
    rules = {**csv.sales_rules(),
             "quantity_above_limit": F.col("quantity") <= 45,
             "date_before_start": F.col("date") >= F.lit("1996-01-01").cast("date")}
    checked = csv.check_rows(csv.coerce(raw, columns), rules)
    return checked.groupBy(F.array_join("failed", ",").alias("failed")).agg(
        F.count("*").alias("n_rows"),
        money(F.sum(F.col("revenue").cast("decimal(18,4)"))).alias("revenue"))


@query
def loaded_sales(m):
    """The fact written as CSV files of two layouts and read back: rows and rejects.

    By fixed rules some product names hold quotes, commas and line breaks, some
    quantities are no numbers, and some records lack a field or have one too many.
    """
    n = F.col("order_id") * 7 + F.col("product_id")
    broken = F.concat(F.lit('"'), "product_name", F.lit(' ""new\nline"", '),
                      (n % 5).cast("string"), F.lit('"'))
    value = {**{c: F.col(c).cast("string") for c in csv.SALES_COLUMNS},
             "product_name": F.when(n % 11 == 0, broken).otherwise(F.col("product_name")),
             "quantity": F.concat(F.when(n % 13 == 0, "x").otherwise(""),
                                  F.col("quantity").cast("string"))}
    layouts = [list(csv.SALES_COLUMNS),
               ["date", "region", "customer_id", "product_name", "revenue", "quantity"]]
    folder, fact = new_path(m.spark, "sales-csv"), m.sales_fact()
    for k, names in enumerate(layouts):
        record = F.when(n % 17 == 0, F.concat_ws(",", *[value[c] for c in names[:-1]])) \
            .otherwise(F.concat(F.concat_ws(",", *[value[c] for c in names]),
                                F.when(n % 19 == 0, ",extra").otherwise("")))
        sinks.write_records(fact.where(F.col("order_id") % 2 == k).select(record),
                            f"{folder}/layout={k}", ",".join(names))
    good, rejects = csv.load_sales(m.spark, f"{folder}/*")
    return good.withColumns({"failed": F.lit(""), "raw": F.lit(None).cast("string")}).unionByName(
        rejects.withColumn("failed", F.array_join("failed", ",")))


@query
def loaded_stock(m):
    """The stock counts written as CSV, some without a quantity, and read as positions."""
    counts = m.stock_snapshots().join(m.products(), "product_id")
    quantity = F.when(F.col("quantity_on_hand") % 23 == 0, "?").otherwise(
        F.col("quantity_on_hand").cast("string"))
    folder = new_path(m.spark, "stock-csv")
    sinks.write_records(counts.select(F.concat_ws(
        ",", F.col("last_updated").cast("string"), quantity, "product_name")), folder,
        "last_updated,quantity_on_hand,product_name")
    good, _ = csv.load_inventory(m.spark, folder, dated=True)
    return csv.stock_counts(good, m.products())


@query
def latest_inventory(m):
    return inventory.latest_inventory(m.stock_snapshots())


@query
def profit_lines(m):
    lines = kpi.with_profit(m.lines())
    return lines.select("order_id", "product_id", "quantity", "unit_price",
                        F.col("revenue").cast("double").alias("revenue"), "cost", "profit", "profit_margin").withColumns(
                            rounded(4, "cost", "profit", "profit_margin"))


@query
def trailing_daily(m):
    daily = trend.trailing_rows(m.daily_totals(last_rows=30), 30)
    return daily.select("date", "total_sales", money("revenue").alias("revenue"),
                        "inventory_level")


@query
def category_long(m):
    return trend.unpivot_categories(m.daily_metrics())


@query
def daily_wide(m):
    return trend.daily_wide(m.category_daily(), CATEGORIES)


# -- totals and rankings ------------------------------------------------------------


@query
def kpi_summary(m):
    return kpi.kpi_summary(*m.both_totals(), m.as_of())


@query
def business_context(m):
    """The one-row context, its best products as rows."""
    context = kpi.business_context(*m.both_totals(), m.as_of())
    return context.withColumn("p", F.explode("top_products")).select(
        "total_revenue", "total_sales_orders", "recent_revenue", "previous_revenue",
        "revenue_change_pct", "recent_share_pct", "p.rank", "p.product_id", "p.name",
        "p.revenue")


@query
def sales_trend(m):
    recent = kpi.sales_trend(m.order_totals(last_days=90), 90, m.as_of())
    return recent.withColumn("revenue", money("revenue"))


@query
def stored_sales_trend(m):
    """The same trend from a stored fact, order totals by month: a first call writes all
    months, later ones those that changed; the reader opens the months since the first
    day only."""
    table = m.stored_orders()
    m.refresh_orders(table)
    first = m.spark.range(1).select(
        F.date_format(F.date_sub(m.as_of(), 90), "yyyy-MM").alias("m")).first()["m"]
    months = [r["month"] for r in table.manifest() if r["month"] >= first]
    recent = kpi.sales_trend(table.read(months), 90, m.as_of())
    return recent.withColumn("revenue", money("revenue"))


@query
def monthly_revenue(m):
    monthly = kpi.monthly_revenue(m.daily_totals())
    return monthly.withColumns({"revenue": money("revenue"),
                                **rounded(4, "cost", "profit", "profit_margin")})


@query
def revenue_by_region(m):
    return _breakdown(kpi.revenue_by_region(m.region_totals()))


@query
def revenue_by_category(m):
    return _breakdown(kpi.revenue_by_category(m.product_totals()))


def _breakdown(df):
    return df.withColumns({"revenue": money("revenue"), **rounded(
        4, "cost", "profit", "profit_margin", "share_pct")})


@query
def top_products(m):
    best = kpi.top_products(m.product_totals(), 10)
    return best.select("product_id", "product_name", "category", "sale_rows", "quantity",
                       money("revenue").alias("revenue"))


@query
def dataset_stats(m):
    return kpi.dataset_stats(m.order_totals(), m.lines())


@query
def kpi_cards(m):
    return _cards(kpi.kpi_cards(m.daily_metrics(last_rows=SIDES)))


@query
def kpi_cards_by_region(m):
    return _cards(kpi.kpi_cards(m.region_metrics(last_rows=SIDES), ["region"]))


def _cards(df):
    return df.withColumns({"revenue_recent": money("revenue_recent"), **rounded(
        4, "sales_day_change_pct", "inventory_day_change_pct", "mean_customers")})


# -- series -------------------------------------------------------------------------


def _period(df):
    return df.withColumns(rounded(4, "recent_mean", "previous_mean", "change_pct"))


@query
def period_over_period(m):
    return _period(trend.period_over_period(m.daily_totals(last_rows=SIDES), "total_sales"))


@query
def period_over_period_by_region(m):
    return _period(trend.period_over_period(m.region_daily(last_rows=SIDES), "revenue",
                                            keys=["region"]))


@query
def period_over_period_short(m):
    """Products rarely sell on 60 dates: the short-history rules decide here."""
    both = [trend.period_over_period(m.product_daily(), "quantity", keys=["product_id"],
                                     short=rule).withColumn("rule", F.lit(rule))
            for rule in ("overlap", "same")]
    return _period(both[0].unionByName(both[1]))


@query
def sales_drop(m):
    drop = trend.sales_drop(m.daily_totals(last_rows=SIDES))
    return _period(drop).withColumns(rounded(4, "lost_revenue"))


@query
def sales_drop_by_region(m):
    drop = trend.sales_drop(m.region_daily(last_rows=SIDES), keys=["region"], threshold=-2.0)
    return _period(drop).withColumns(rounded(4, "lost_revenue"))


@query
def day_over_day(m):
    days = trend.day_over_day(m.daily_totals(), "total_sales")
    return days.select("date", "total_sales", "change_pct").withColumns(
        rounded(4, "change_pct"))


@query
def day_over_day_by_region(m):
    days = trend.day_over_day(m.region_daily(), "total_sales", ["region"])
    return days.select("region", "date", "total_sales", "change_pct").withColumns(
        rounded(4, "change_pct"))


@query
def moving_average_7(m):
    days = trend.moving_average(m.daily_totals(), "total_sales", 7)
    return days.select("date", "total_sales", "moving_average").withColumns(
        rounded(4, "moving_average"))


@query
def moving_average_7_by_region(m):
    days = trend.moving_average(m.region_daily(), "total_sales", 7, ["region"])
    return days.select("region", "date", "total_sales", "moving_average").withColumns(
        rounded(4, "moving_average"))


@query
def category_means(m):
    return trend.category_means(m.daily_metrics()).withColumns(rounded(4, "mean_sales"))


@query
def top_categories(m):
    best = trend.top_categories(m.daily_metrics(), 3)
    return best.select("date", "rank", "category", "display_name", "sales")


@query
def top_categories_by_region(m):
    best = trend.top_categories(m.region_metrics(), 2, keys=["region"])
    return best.select("region", "date", "rank", "category", "sales")


@query
def metric_correlation(m):
    corr = trend.metric_correlation(m.daily_totals(), "total_sales", "inventory_level")
    return corr.withColumns(rounded(6, "correlation"))


@query
def metric_correlation_by_region(m):
    corr = trend.metric_correlation(m.region_daily(), "total_sales", "inventory_level",
                                    ["region"])
    return corr.withColumns(rounded(6, "correlation"))


def _health(df):
    return df.withColumns(rounded(4, "mean_inventory", "mean_sales", "days_of_supply"))


@query
def inventory_health(m):
    return _health(inventory.inventory_health(m.daily_totals(last_rows=30)))


@query
def inventory_health_by_region(m):
    return _health(inventory.inventory_health(m.region_daily(last_rows=30), keys=["region"]))


# -- customers ----------------------------------------------------------------------


@query
def rfm_segments(m):
    return customers.rfm_segments(m.order_totals(), m.as_of())


@query
def rfm_summary(m):
    summary = customers.rfm_summary(customers.rfm_segments(m.order_totals(), m.as_of()))
    return summary.withColumns({"revenue": money("revenue"),
                                **rounded(4, "mean_recency")})


@query
def retention_actions(m):
    return advise.retention_actions(
        customers.rfm_segments(m.order_totals(), m.as_of()))


# -- stock --------------------------------------------------------------------------


def _position(m):
    stock = inventory.latest_inventory(m.stock_snapshots())
    demand = inventory.demand_rate(m.dated_lines(last_days=30), m.as_of())
    return inventory.stock_position(m.products(), stock, demand)


@query
def inventory_status(m):
    status = inventory.inventory_status(_position(m))
    return status.select(
        "product_id", "product_name", "category", "quantity_on_hand", "recent_quantity",
        "daily_demand", "days_of_stock", "risk", "below_reorder").withColumns(
            rounded(4, "daily_demand", "days_of_stock"))


@query
def inventory_needs(m):
    needs = inventory.inventory_needs(_position(m))
    return needs.select("product_id", "quantity_on_hand", "expected_demand",
                        "restock_quantity").withColumns(rounded(4, "expected_demand"))


def _demand_ahead(m):
    """The flat forecast; products that never sell have none."""
    return forecast.demand_forecast(m.product_daily(), as_of=m.as_of())


@query
def stock_projection(m):
    """Stock day by day under the flat forecast, with orders in transit."""
    days = inventory.project_stock(_position(m), _demand_ahead(m), m.in_transit())
    return days.withColumns(rounded(4, "demand", "stock", "lost"))


@query
def restock_plan(m):
    plan = inventory.restock_plan(_position(m), _demand_ahead(m), m.in_transit())
    return plan.withColumns(rounded(4, "expected_demand", "lost_demand", "lowest_stock"))


@query
def restock_list(m):
    urgent = inventory.restock_list(_position(m))
    return urgent.select("product_id", "product_name", "quantity_on_hand",
                         "days_of_stock", "urgency", "restock_quantity").withColumns(
                             rounded(4, "days_of_stock"))


@query
def inventory_anomalies(m):
    found = inventory.inventory_anomalies(inventory.inventory_status(_position(m)))
    return found.select("product_id", "product_name", "days_of_stock", "risk", "z_score",
                        "anomaly_type").withColumns(rounded(4, "days_of_stock", "z_score"))


@query
def pricing_suggestions(m):
    prices = advise.pricing_suggestions(m.all_product_totals())
    return prices.withColumns(rounded(4, "unit_revenue", "suggested_price"))


# -- outliers -----------------------------------------------------------------------


def _records(df):
    return df.withColumns(rounded(4, "z_score"))


@query
def zscore_daily(m):
    return _records(anomaly.zscore_anomalies(m.daily_totals(), "revenue", z=2.0))


@query
def zscore_products(m):
    found = anomaly.zscore_anomalies(m.product_daily(), "revenue", ["product_id"])
    named = found.join(m.products().select("product_id", "product_name"), "product_id")
    return _records(named)


@query
def recent_anomalies(m):
    scored = anomaly.zscores(m.daily_totals(), "revenue", z=1.5)
    recent = anomaly.recent_anomalies(scored, 90)
    return recent.select("date", money("revenue").alias("revenue"), "expected",
                         "z_score").withColumns(rounded(4, "z_score"))


@query
def unified_alerts(m):
    """Outlier days, outlier product days and stock risks in one table."""
    days = anomaly.zscore_anomalies(m.daily_totals(), "revenue", z=2.0).select(
        F.lit("revenue").alias("alert"), "date", "expected_sales", "actual_sales",
        "severity")
    items = anomaly.zscore_anomalies(m.product_daily(), "revenue", ["product_id"]).select(
        F.lit("product").alias("alert"), "date", "product_id", "expected_sales",
        "actual_sales", "severity")
    stock = inventory.inventory_status(_position(m)).filter(
        F.col("risk") == "critical").select(
            F.lit("inventory").alias("alert"), "product_id", "days_of_stock",
            F.lit("critical").alias("severity"))
    return anomaly.unified_alerts(days, items, stock).withColumns(
        rounded(4, "days_of_stock"))


@query
def revenue_features(m):
    return anomaly.revenue_features(m.daily_totals()).withColumns(
        rounded(4, "change_pct"))


@query
def iforest_daily(m):
    daily = m.daily_totals().select("date", "total_sales")
    scored = isolation_forest(daily, ["total_sales"], ["date"])
    return scored.filter("is_anomaly")


@query
def iforest_revenue(m):
    return anomaly.revenue_anomalies(m.daily_totals())


@query
def iforest_region(m):
    daily = m.region_daily().select("region", "date", "total_sales")
    scored = isolation_forest_by_key(daily, ["total_sales"], ["region"])
    return scored.filter("is_anomaly")


# -- forecasts ----------------------------------------------------------------------


def _forecast(df):
    return df.withColumns(rounded(4, "yhat", "lower", "upper"))


@query
def moving_average_forecast(m):
    return _forecast(forecast.moving_average_forecast(
        m.daily_totals(last_rows=30), "total_sales"))


@query
def moving_average_forecast_by_region(m):
    return _forecast(forecast.moving_average_forecast(
        m.region_daily(last_rows=30), "total_sales", keys=["region"]))


@query
def holt_winters_daily(m):
    return forecast.holt_winters(m.daily_totals(), "total_sales")


@query
def holt_winters_region(m):
    return forecast.holt_winters(m.region_daily(), "revenue", keys=["region"])


@query
def seasonal_forecast(m):
    return forecast.seasonal_forecast(m.region_daily(), "revenue", keys=["region"])


@query
def revenue_forecast(m):
    return forecast.revenue_forecast(m.daily_totals(), 30)


@query
def demand_forecast(m):
    return _forecast(forecast.demand_forecast(m.product_daily(), as_of=m.as_of()))


@query
def demand_holt_winters(m):
    """Every product's demand fitted on the last 52 weeks, never-sold products included."""
    return forecast.demand_forecast(m.product_daily(last_days=364), as_of=m.as_of(), history=364,
                                    method="holt_winters", products=m.products())


@query
def trend_change_points(m):
    """Where the trend of new customers a day bends."""
    return forecast.change_points(m.new_customers_daily(), "customers")


@query
def filled_days(m):
    """The gap-free daily series the forecasts are fitted on."""
    return forecast.fill_days(m.region_daily(), "total_sales", ["region"])


@query
def forecast_delta(m):
    """A flat forecast from 90 rows against the last 30 rows."""
    daily = m.daily_totals(last_rows=90)
    ahead = forecast.moving_average_forecast(daily, "total_sales", window=90)
    return _delta(forecast.forecast_vs_actual(ahead, daily, "total_sales"))


@query
def forecast_delta_by_region(m):
    daily, keys = m.region_daily(last_rows=90), ["region"]
    ahead = forecast.moving_average_forecast(daily, "total_sales", keys=keys, window=90)
    return _delta(forecast.forecast_vs_actual(ahead, daily, "total_sales", keys=keys))


def _delta(df):
    return df.withColumns(rounded(4, "forecast_mean", "lower_mean", "upper_mean",
                                  "actual_mean", "delta"))


def _errors(df):
    return df.withColumns(rounded(4, "bias", "mae", "rmse", "wape", "coverage"))


@query
def forecast_backtest(m):
    """Flat forecasts of six past days for every region, beside what followed."""
    daily = stage(m.region_daily(), "region-daily")     # read by origins, days and last date
    ahead = forecast.rolling_origins(daily, "total_sales", keys=["region"])
    return forecast.on_days(ahead, daily, "total_sales", ["region"]).withColumns(
        rounded(4, "yhat", "lower", "upper", "actual"))


@query
def forecast_errors(m):
    """Errors of flat forecasts by days ahead."""
    daily = stage(m.region_daily(), "region-daily")
    ahead = forecast.rolling_origins(daily, "total_sales", keys=["region"])
    return _errors(forecast.error_measures(
        forecast.on_days(ahead, daily, "total_sales", ["region"])))


@query
def holt_winters_errors(m):
    """Errors of fitted forecasts by region and days ahead, one fit a region and origin."""
    daily = stage(m.region_daily(), "region-daily")
    ahead = forecast.rolling_origins(daily, "total_sales", "holt_winters", ["region"], history=364)
    return _errors(forecast.error_measures(
        forecast.on_days(ahead, daily, "total_sales", ["region"]), ["region", "step"]))


# -- advice -------------------------------------------------------------------------


def _flat(df):
    return df.withColumn("action_items", F.array_join("action_items", "; "))


@query
def recommendations(m):
    return _flat(advise.recommendations(kpi.business_snapshot(m.daily_metrics(last_rows=SIDES))))


@query
def recommendations_by_region(m):
    state = kpi.business_snapshot(m.region_metrics(last_rows=SIDES), ["region"])
    return _flat(advise.recommendations(state, ["region"]))


@query
def action_plan(m):
    plan = advise.action_plan(kpi.business_snapshot(m.daily_metrics(last_rows=SIDES)))
    return plan.withColumns(rounded(4, "measure"))


@query
def all_recommendations(m):
    segments = customers.rfm_segments(m.order_totals(), m.as_of())
    return _flat(advise.all_recommendations(
        advise.recommendations(kpi.business_snapshot(m.daily_metrics(last_rows=SIDES))),
        advise.restock_advice(inventory.restock_list(_position(m))),
        advise.pricing_advice(advise.pricing_suggestions(m.all_product_totals())),
        advise.retention_advice(advise.retention_actions(segments))))


# -- questions ----------------------------------------------------------------------


@query
def intent_counts(m):
    asked = questions.classify_intent(m.questions())
    return asked.groupBy("intent").agg(F.count("*").alias("n_questions"))


def _answered(m, asked, method="moving_average"):
    """Answers to questions; a fact is computed only if an intent that occurs needs it."""
    needed = set().union(*(questions.FACTS[i] for i in questions.intents_asked(asked)))
    facts = {}
    if needed:
        daily = stage(m.daily_metrics(), "daily")     # read by all facts
        if "snapshot" in needed:
            facts["snapshot"] = kpi.business_snapshot(daily)
        if "correlation" in needed:
            facts["correlation"] = trend.metric_correlation(daily, "total_sales",
                                                            "inventory_level")
        if "forecast" in needed:
            ahead = forecast.holt_winters(daily, "total_sales") if method == "holt_winters" \
                else forecast.moving_average_forecast(daily, "total_sales")
            facts["forecast"] = forecast.forecast_vs_actual(ahead, daily, "total_sales")
    answered = questions.answer_questions(asked, **facts)
    return answered.select("question_id", "intent", "answer", "measure", "confidence",
                           F.array_join("sources", "; ").alias("sources")).withColumns(
                               rounded(4, "measure"))


@query
def product_intent_counts(m):
    asked = questions.classify_intent(m.product_questions())
    return asked.groupBy("intent").agg(F.count("*").alias("n_questions"))


@query
def answers(m):
    return _answered(m, m.questions())


@query
def product_answers(m):
    """Answers to questions about every product, which reach all intents."""
    return _answered(m, m.product_questions())


@query
def fitted_answers(m):
    """The same with the fitted forecast."""
    return _answered(m, m.product_questions(), "holt_winters")


@query
def fitted_delta(m):
    """The fitted forecast of every region against its last 30 rows."""
    daily, keys = stage(m.region_daily(), "region-daily"), ["region"]
    ahead = forecast.holt_winters(daily, "total_sales", keys=keys)
    return _delta(forecast.forecast_vs_actual(ahead, daily, "total_sales", keys=keys))


@query
def prompt_context(m):
    context = kpi.business_context(*m.both_totals(), m.as_of())
    prompts = questions.build_prompts(m.questions(history_tokens=500), context)
    return prompts.select("question_id", "prompt")


# -- streams ------------------------------------------------------------------------


@query
def stream_daily_totals(m):
    """All event files as one stream, every day's totals replaced as they change."""
    totals = alerts.daily_totals(m.event_stream(), "ts", "value", ["event_type"])
    running, table = alerts.start_update(totals, ["event_type"], "daily-totals")
    running.awaitTermination()
    return table.read().drop("month").withColumn("total", money("total"))


@query
def stream_stock_days(m):
    """Every product's days with stock, demand and alerts, kept by the stream of movements."""
    running, table = stock.keep_stock(stock.stock_days(m.movement_stream()))
    running.awaitTermination()
    return table.read().drop("month").withColumns(
        rounded(6, "mean_demand", "days_of_supply", "change_pct"))


@query
def stream_daily_alerts(m):
    """Closed days whose total lies 10 % or more below the batch mean of their type."""
    per_day = m.table("events").groupBy(
        "event_type", F.col("ts").cast("date").alias("date")).agg(
            F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    baseline = stage(per_day.groupBy("event_type").agg(        # read by every batch
        (F.sum("total").cast("double") / F.count("*")).alias("expected")), "expected")
    low = alerts.daily_alerts(m.event_stream(), baseline, "ts", "value", ["event_type"],
                              threshold=-10.0)
    running, out = alerts.start_append(low, "daily-alerts")
    running.awaitTermination()
    return m.spark.read.schema(low.schema).parquet(out).withColumns(
        {"total": money("total"), **rounded(4, "expected", "change_pct")})

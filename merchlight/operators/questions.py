"""Questions in a table: intent by keyword, data-backed answers, prompt texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from merchlight.functions.measures import fixed_text
from merchlight.operators.inventory import LOW_DAYS

# Intents in order of precedence, each with its keywords.
INTENT_RULES = [
    ("drop", ["drop", "decrease", "why"]),
    ("forecast", ["forecast", "predict", "future"]),
    ("inventory", ["inventory"]),
    ("recommend", ["recommend"]),
]
GENERAL = "general"

#: The facts that an answer of each intent rests on.
FACTS = {"drop": {"snapshot", "correlation"}, "forecast": {"forecast"},
         "inventory": {"snapshot"}, "recommend": {"snapshot"}, GENERAL: set()}

# Fixed value: the confidence reported with every answer.
CONFIDENCE = 0.85


def intent_of(question: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """First rule with a keyword inside the lower-cased text (substring, not word)."""
    text = F.lower(question)
    intent = F.lit(None).cast("string")
    for name, keywords in reversed(rules):
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | text.contains(keyword)
        intent = F.when(hit, name).otherwise(intent)
    return F.coalesce(intent, F.lit(GENERAL))


def classify_intent(questions: DataFrame, rules=INTENT_RULES) -> DataFrame:
    return questions.withColumn("intent", intent_of(F.col("question"), rules))


def intents_asked(questions: DataFrame, rules=INTENT_RULES) -> set[str]:
    """The intents that occur, at most one more than there are rules."""
    return {r["intent"] for r in classify_intent(questions, rules).select("intent")
            .distinct().collect()}


def answer_questions(questions: DataFrame, snapshot: DataFrame | None = None,
                     forecast: DataFrame | None = None, correlation: DataFrame | None = None,
                     rules=INTENT_RULES) -> DataFrame:
    """An answer, the measure it rests on, its sources and confidence, per question.

    ``snapshot``, ``forecast`` (means over the horizon, of any method) and
    ``correlation`` are one row each and enter as scalar subqueries: the questions are
    only mapped. A fact that no intent asked needs may be left out (``FACTS``); where it
    was needed, the answer is null.
    """
    state, ahead, corr = (F.lit(None).cast(kind) for kind in (
        "struct<change_pct:double,is_drop:boolean,lost_revenue:double,days_of_supply:double,"
        "best:string>", "struct<forecast_mean:double,lower_mean:double,upper_mean:double>", "double"))
    if snapshot is not None:
        state = snapshot.select(F.struct(
            "change_pct", "is_drop", "lost_revenue", "days_of_supply",
            F.array_join(F.transform(F.slice("top_categories", 1, 2), lambda c: c["name"]),
                         ", ").alias("best"))).scalar()
    if forecast is not None:
        ahead = forecast.select(F.struct("forecast_mean", "lower_mean", "upper_mean")).scalar()
    if correlation is not None:
        corr = correlation.select("correlation").scalar()

    asked = classify_intent(questions, rules)
    intent = F.col("intent")
    drop = F.when(state["is_drop"], F.concat(
        F.lit("Sales fell by "), fixed_text(F.abs(state["change_pct"]), 1),
        F.lit(" percent against the period before; correlation with stock is "),
        F.coalesce(fixed_text(corr, 2), F.lit("not defined")),
        F.lit("; revenue at risk per day is about "),
        fixed_text(state["lost_revenue"], 0))
    ).otherwise(F.concat(
        F.lit("No marked drop: sales changed by "), fixed_text(state["change_pct"], 1),
        F.lit(" percent")))
    outlook = F.concat(
        F.lit("Expected daily sales are "), fixed_text(ahead["forecast_mean"], 0),
        F.lit(", between "), fixed_text(ahead["lower_mean"], 0), F.lit(" and "),
        fixed_text(ahead["upper_mean"], 0))
    stock = F.concat(
        F.when(state["days_of_supply"] < LOW_DAYS,
               F.concat(F.lit("Restock "), state["best"], F.lit(": stock covers ")))
         .otherwise(F.lit("Stock covers ")),
        fixed_text(state["days_of_supply"], 1), F.lit(" days"))
    advice = F.concat(F.lit("Strongest categories: "), state["best"],
                      F.lit("; change of sales in percent: "),
                      fixed_text(state["change_pct"], 1),
                      F.lit("; days of supply: "), fixed_text(state["days_of_supply"], 1))
    answer = F.when(intent == "drop", drop).when(intent == "forecast", outlook) \
              .when(intent == "inventory", stock).when(intent == "recommend", advice) \
              .otherwise("Ask about a sales drop, a forecast, inventory or "
                         "recommendations")
    measure = F.when(intent == "drop", state["change_pct"]) \
               .when(intent == "forecast", ahead["forecast_mean"]) \
               .when(intent == "inventory", state["days_of_supply"])
    sources = F.when(intent == "drop", F.array(F.lit("daily sales"), F.lit("inventory"))) \
               .when(intent == "forecast", F.array(F.lit("daily sales"))) \
               .when(intent == "inventory", F.array(F.lit("inventory"),
                                                    F.lit("daily sales"))) \
               .when(intent == "recommend", F.array(F.lit("category sales"))) \
               .otherwise(F.array().cast("array<string>"))
    return asked.withColumns({"answer": answer, "measure": measure, "sources": sources,
                              "confidence": F.lit(CONFIDENCE)})


def build_prompts(questions: DataFrame, context: DataFrame, top: int = 3) -> DataFrame:
    """Prompt text per question from a one-row business context; no model is called.

    The context goes first as JSON, then an optional ``history`` column, then the question.
    """
    facts = context.select(F.to_json(F.struct(
        fixed_text("total_revenue").alias("total_revenue"),
        fixed_text("recent_revenue").alias("recent_revenue"),
        fixed_text("recent_share_pct", 0).alias("recent_share_pct"),
        fixed_text("revenue_change_pct", 1).alias("revenue_change_pct"),
        F.array_join(F.transform(F.slice("top_products", 1, top), lambda p: p["name"]),
                     ", ").alias("top_products")))).scalar()
    parts = [facts]
    if "history" in questions.columns:
        parts.append(F.col("history"))
    parts.append(F.col("question"))
    return questions.withColumn("prompt", F.concat_ws("\n", *parts))

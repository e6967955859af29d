import pytest

from merchlight.operators import advise, kpi, questions
from tests.conftest import day


def snapshot(series, recent, stock):
    values = [100.0] * 30 + [recent] * 30
    daily = series(values, revenue=values, inventory_level=[stock] * 60,
                   customers=[1] * 60, toys_sales=[1] * 60, home_sales=[2] * 60)
    return kpi.business_snapshot(daily)


@pytest.mark.parametrize("recent,stock,kinds", [
    (100, 100 * 19.9, ["restock", "category", "category"]),
    (100, 100 * 20, ["category", "category"]),
    (100, 100 * 90, ["category", "category"]),
    (100, 100 * 91, ["inventory", "category", "category"]),
    (50, 50 * 30, ["promotion", "category", "category"]),
])
def test_rules(series, recent, stock, kinds):
    got = advise.recommendations(snapshot(series, recent, stock)).collect()
    assert [r.type for r in got] == kinds
    assert [r.title for r in got][-2:] == ["Back Home", "Back Toys"]


def test_default_when_nothing_fires(series):
    values = [100.0] * 60
    daily = series(values, revenue=values, inventory_level=[3000] * 60)
    state = kpi.business_snapshot(daily)
    from pyspark.sql import functions as F
    empty = F.array().cast("array<struct<category:string,name:string,sales:double>>")
    got = advise.recommendations(state.withColumn("top_categories", empty)).collect()
    assert [r.type for r in got] == ["status"]


def test_action_plan(series):
    got = {r.step: r for r in advise.action_plan(snapshot(series, 50, 100)).collect()}
    assert (got[1].decision, got[1].target) == ("urgent_restock", "Home")
    assert got[2].decision == "recovery" and got[3].target == "Home"
    got = {r.step: r for r in advise.action_plan(snapshot(series, 100, 9000)).collect()}
    assert (got[1].decision, got[2].decision) == ("hold", "growth")


@pytest.mark.parametrize("text,intent", [
    ("Why is that?", "drop"), ("a DROPDOWN list", "drop"), ("forecast the decrease", "drop"),
    ("Predict inventory", "forecast"), ("The future", "forecast"),
    ("inventory, recommend", "inventory"), ("Recommendations?", "recommend"),
    ("hello", "general"), ("", "general"), (None, "general")])
def test_intents_in_order(spark, text, intent):
    df = spark.createDataFrame([(1, text)], "question_id int, question string")
    assert questions.classify_intent(df).first().intent == intent


def test_own_rules(spark):
    df = spark.createDataFrame([(1, "churn?")], "question_id int, question string")
    got = questions.classify_intent(df, [("customers", ["churn"])]).first()
    assert got.intent == "customers"


def test_answers(spark, series):
    asked = spark.createDataFrame(
        [(1, "why"), (2, "forecast"), (3, "inventory"), (4, "recommend"), (5, "hi")],
        "question_id int, question string")
    ahead = spark.createDataFrame([(10.0, 8.0, 12.0)],
                                  "forecast_mean double, lower_mean double, upper_mean double")
    corr = spark.createDataFrame([(None,)], "correlation double")
    got = {r.question_id: r for r in questions.answer_questions(
        asked, snapshot(series, 50, 100), ahead, corr).collect()}
    assert "50.0 percent" in got[1].answer and "not defined" in got[1].answer
    assert got[1].measure == -50 and got[1].sources == ["daily sales", "inventory"]
    assert got[2].answer.endswith("10, between 8 and 12")
    assert got[3].answer == "Restock Home, Toys: stock covers 2.0 days"
    assert "Home, Toys" in got[4].answer and got[5].sources == []


def test_prompts(spark):
    from decimal import Decimal
    sales = spark.createDataFrame([(day(5), 1, 1, Decimal("12.5"))],
                                  "date date, sale_rows int, quantity int, revenue decimal(18,4)")
    products = spark.createDataFrame([(1, "rod", Decimal("12.5"))],
                                     "product_id int, product_name string, "
                                     "revenue decimal(18,4)")
    asked = spark.createDataFrame([(1, "So?", "Earlier"), (2, "And?", None)],
                                  "question_id int, question string, history string")
    got = {r.question_id: r.prompt for r in questions.build_prompts(
        asked, kpi.business_context(sales, products)).collect()}
    assert '"total_revenue":"12.50"' in got[1] and '"top_products":"rod"' in got[1]
    assert "\nEarlier" in got[1] and "Earlier" not in got[2]
    assert got[2].endswith("And?")


def test_product_questions_reach_all_intents_with_the_fitted_forecast(spark, tables):
    from merchlight.operators import forecast, questions
    from merchlight.plans.model import SalesModel
    from merchlight.plans.queries import run
    m = SalesModel(spark, tables)
    got = run("fitted_answers", spark, tables).collect()
    assert {r["intent"] for r in got} == {"drop", "forecast", "inventory", "recommend", "general"}
    assert len(got) == m.products().count() and all(r["answer"] for r in got)
    ahead = [r["yhat"] for r in forecast.holt_winters(m.daily_metrics(), "total_sales").collect()]
    for r in got:
        if r["intent"] == "forecast":
            assert r["measure"] == round(sum(ahead) / len(ahead), 4)
            assert f"{sum(ahead) / len(ahead):.0f}" in r["answer"]
    asked = m.product_questions()
    assert questions.intents_asked(asked) == {r["intent"] for r in got}
    none = questions.answer_questions(asked)
    assert none.where("answer IS NOT NULL AND intent <> 'general'").count() == 0
    assert none.where("answer IS NULL AND intent = 'general'").count() == 0


def test_fitted_delta_uses_the_fitted_forecast(spark, tables):
    from merchlight.operators import forecast
    from merchlight.plans.model import SalesModel
    from merchlight.plans.queries import run
    m = SalesModel(spark, tables)
    ahead = {}
    for r in forecast.holt_winters(m.region_daily(), "total_sales", keys=["region"]).collect():
        ahead.setdefault(r["region"], []).append(r["yhat"])
    for r in run("fitted_delta", spark, tables).collect():
        mean = sum(ahead[r["region"]]) / 30
        assert abs(r["forecast_mean"] - mean) < 1e-3
        assert abs(r["delta"] - (mean - r["actual_mean"])) < 1e-3


def told(turns, budget):
    """Every turn's history by a plain walk back."""
    lines = {}
    for conv, turn, role, text in turns:
        if text is not None:
            lines.setdefault((conv, turn), set()).add(f"{role}: {text}")
    by = {}
    for (conv, turn), found in lines.items():
        own = sorted(found)
        by.setdefault(conv, []).append((turn, "\n".join(own), sum(len(x.split()) for x in own) + 1))
    out = {}
    for conv, rows in by.items():
        rows.sort()
        for i, (turn, *_) in enumerate(rows):
            kept, left = [], budget
            for _, text, size in reversed(rows[:i]):
                left -= size
                if left < 0:
                    break
                kept.append(text)
            if kept:
                out[conv, turn] = "\n".join(reversed(kept))
    return out


@pytest.mark.parametrize("budget", [3, 25, 400])
def test_history_of_long_conversations_over_many_tasks(spark, budget):
    import random

    from merchlight.plans.model import chat_history
    draw = random.Random(2)
    turns = [(1, t, "ua"[t % 2], " ".join("w" * draw.randint(0, 9))) for t in range(900)]
    turns += [(c, t, "u", f"c{c} t{t}") for c in range(2, 40) for t in range(draw.randint(0, 6))]
    turns += [(2, 0, "u", "c2 t0"), (2, 0, "a", "another"), (1, 7, "u", None), (3, 1, "u", "x " * 500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["history"] for r in chat_history(df.repartition(6), budget).collect()}
    assert got == told(turns, budget)


def test_running_totals_do_not_depend_on_tasks(spark):
    from merchlight.functions.running import running_before
    rows = [("a" if i % 3 else None, i, i % 5 if i % 4 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    got = {(r["k"], r["i"]): r["t"] for r in running_before(df, ["k"], "i", "v", "t").collect()}
    sums, want = {}, {}
    for k, i, v in rows:
        want[k, i] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + (v or 0)
    assert got == want

"""Every registered query with SQL gives the same rows, on given and skewed tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from merchlight.plans.queries import QUERIES
from tests import compare

SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}
WITHOUT_SQL = {"iforest_daily", "iforest_revenue", "iforest_region", "holt_winters_daily",
               "holt_winters_region", "seasonal_forecast", "revenue_forecast",
               "demand_holt_winters", "trend_change_points", "holt_winters_errors",
               "fitted_answers", "fitted_delta"}


@pytest.fixture(scope="session")
def sql_tables(tables):
    return compare.connect(tables)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, sql_tables, name):
    df = driver.queries()[name](spark, tables)
    assert compare.differences(df, sql_tables, SQL[name]) == []


def test_every_query_is_checked_or_listed():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_runs(spark, tables, name):
    assert driver.queries()[name](spark, tables).count() > 0


def test_comparison_notices_a_wrong_value(spark, tables, sql_tables):
    df = driver.queries()["revenue_by_region"](spark, tables)
    wrong = SQL["revenue_by_region"].replace("* 0.6", "* 0.61")
    assert compare.differences(df, sql_tables, wrong)


def test_entry(spark):
    assert driver.entry(spark).count() == 1


# -- skew: a third of the lines in one order and one product, a third of the orders at
# -- one customer, a third of the events of one type, and products that never sell


@pytest.fixture(scope="session")
def skewed(tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    changed = {
        "lineitem": """SELECT * EXCLUDE (n) REPLACE (
            CASE WHEN n % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN n % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey)
          FROM (SELECT *, row_number() OVER () AS n FROM {src})""",
        "orders": """SELECT * REPLACE (
            CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)
          FROM {src}""",
        "part": """SELECT * FROM {src} UNION ALL
          SELECT p_partkey + 1000000, p_name, p_brand, p_type, p_size, p_retailprice
          FROM {src} WHERE p_partkey < 50""",
        "events": """SELECT * REPLACE (
            CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS event_type)
          FROM {src}""",
        # copies of two turns of one conversation
        "conversations": """SELECT * EXCLUDE (n) REPLACE (
            CASE WHEN n % 3 = 0 THEN 0 ELSE conv_id END AS conv_id,
            CASE WHEN n % 3 = 0 THEN n % 2 ELSE turn END AS turn)
          FROM (SELECT *, row_number() OVER () AS n FROM {src})""",
    }
    for name in ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split():
        src = f"'{tables}/{name}.parquet'"
        select = changed.get(name, "SELECT * FROM {src}").format(src=src)
        con.execute(f"COPY ({select}) TO '{folder}/{name}.parquet' "
                    "(FORMAT parquet, ROW_GROUP_SIZE 2048)")
    return str(folder)


SKEW_NAMES = ["sales_fact", "kpi_summary", "revenue_by_region", "revenue_by_category",
              "kpi_cards", "daily_wide", "dataset_stats", "rfm_segments",
              "retention_actions", "zscore_products", "inventory_status", "restock_list",
              "pricing_suggestions", "demand_forecast", "period_over_period_short",
              "answers", "prompt_context", "stored_sales_trend",
              "recommendations_by_region", "stream_daily_totals", "stream_daily_alerts"]


@pytest.mark.parametrize("name", SKEW_NAMES)
def test_query_on_skewed_tables(spark, skewed, name):
    df = driver.queries()[name](spark, skewed)
    assert compare.differences(df, compare.connect(skewed), SQL[name]) == []


@pytest.mark.parametrize("name", ["sales_fact", "zscore_products", "daily_wide",
                                  "moving_average_7_by_region"])
def test_shuffled_joins_split_hot_keys(spark, skewed, name):
    """Without broadcasts the joins split the hot key, and results stay the same.

    Sizes are scaled down so that small tables show what large ones do: many map
    tasks and many partitions, one of them far above the median.
    """
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "64",
            "spark.sql.files.maxPartitionBytes": "40KB",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = driver.queries()[name](spark, skewed)
        assert compare.differences(df, compare.connect(skewed), SQL[name]) == []
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["folders", "dependency"])
def test_entry_works_without_the_training_part(tmp_path, how):
    """Without its folders, or what it needs, the other queries are all there."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    skip = ("llm", "corpus_pipeline.py") if how == "folders" else ()
    shutil.copytree(root, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__", *skip)])
    hide = "" if how == "folders" else (
        "import sys\nclass Hide:\n    def find_spec(self, name, *more):\n"
        "        if name.split('.')[0] == 'public_tokenizers':\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Hide())\n")
    code = hide + ("import __spark_entry__ as e\n"
                   "print(sorted(e.queries()) == sorted(e.registered.QUERIES), "
                   "set(e.oracle_sql()) <= set(e.queries()))")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, text=True, capture_output=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.strip() == "True True", done.stderr

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from merchlight.plans.model import SalesModel

from merchlight.session import shared_dir, stage
from merchlight.sources import csv, sinks
from merchlight.streaming import alerts
from tests.conftest import day


def write(path, text):
    path.write_text(text)
    return str(path)


def test_daily_csv_binds_by_name(spark, tmp_path):
    text = ("customers,date,toys_sales,total_sales,revenue,inventory_level\n"
            "7,2024-01-02 10:11:12.345678,1.5,10.5,99,500\n"
            "8,2024-01-01 10:11:12.345678,2.5,NaN,oops,400\n")
    got = csv.read_daily_metrics(spark, write(tmp_path / "d.csv", text)).collect()
    assert [r.date for r in got] == [day(0), day(1)]
    assert (got[1].customers, got[1].total_sales, got[1].toys_sales) == (7, 10.5, 1.5)
    assert got[0].total_sales is None and got[0].revenue is None


def test_csv_files_with_other_headers_bind_by_name_or_fail(spark, tmp_path):
    write(tmp_path / "a.csv", "product_name,quantity_on_hand\nrod,1\n")
    write(tmp_path / "b.csv", "quantity_on_hand,product_name\n2,bolt\n")
    got = csv.read_text_table(spark, str(tmp_path)).collect()
    assert sorted((r["product_name"], r["quantity_on_hand"]) for r in got) == [("bolt", "2"), ("rod", "1")]
    with pytest.raises(Exception):
        csv.read_text_table(spark, str(tmp_path), multi_line=False).collect()


def test_missing_column_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="quantity_on_hand"):
        csv.load_inventory(spark, write(tmp_path / "i.csv", "product_name\nrod\n"))


def test_sales_csv_good_and_rejects(spark, tmp_path):
    text = ("product_name,quantity,revenue,customer_id,region,date\n"
            "rod,2,10.5,C1,N,2024-01-01\n"
            "rod,0,10,C1,N,2024-01-01\n"
            ",x,-1,,S,2024-13-01\n"
            "bolt,1,0,C2,E,2024-01-03\n")
    good, rejects = csv.load_sales(spark, write(tmp_path / "s.csv", text))
    assert {(r.product_name, r.quantity, r.date) for r in good.collect()} == \
        {("rod", 2, day(0)), ("bolt", 1, day(2))}
    assert sorted(r.failed for r in rejects.collect()) == [
        ["product_missing", "quantity_invalid", "revenue_invalid", "customer_missing",
         "date_invalid"], ["quantity_invalid"]]
    products = spark.createDataFrame([("rod",)], "product_name string")
    assert [r.product_name for r in csv.unknown_products(good, products).collect()] == ["bolt"]


def test_inventory_csv(spark, tmp_path):
    good, rejects = csv.load_inventory(spark, write(
        tmp_path / "i.csv", "product_name,quantity_on_hand\nrod,5\nbolt,-1\n"))
    assert good.count() == 1 and rejects.first().failed == ["quantity_invalid"]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_write_and_read_back(spark, tmp_path, kind):
    df = spark.createDataFrame([(day(i * 20), float(i)) for i in range(6)],
                               "date date, revenue double")
    path = str(tmp_path / kind)
    sinks.write_table(sinks.with_month(df), path, kind, partition_by=["month"])
    reader = spark.read.option("header", True).schema("date date, revenue double, month string")
    back = reader.format(kind).load(path)
    assert {(r.date, r.revenue) for r in back.collect()} == \
        {(r.date, r.revenue) for r in df.collect()}
    assert back.filter("month = '2024-01'").count() == 2
    with pytest.raises(Exception):          # an existing table is not overwritten
        sinks.write_table(df, path, kind)


def test_stage_is_a_stored_copy(spark):
    df = spark.range(10).withColumn("r", F.rand())
    stored = stage(df, "copy")
    assert stored.collect() == stored.collect() and stored.count() == 10
    assert any(f.startswith(("file:", "/")) for f in stored.inputFiles())
    assert shared_dir(spark) in stored.inputFiles()[0].replace("file:///", "file:/") \
        or shared_dir(spark).split(":")[-1] in stored.inputFiles()[0]


def test_worker_functions_need_no_package_on_the_executors(tmp_path):
    from pyspark import cloudpickle

    from merchlight.operators.forecast import _fit_holt_winters
    path = tmp_path / "f.pkl"
    path.write_bytes(cloudpickle.dumps(_fit_holt_winters))
    code = (f"import pickle, numpy as np; f = pickle.load(open({str(path)!r}, 'rb'));"
            "print(f(np.full(21, 4.0), 7, 2)[0].round(6).tolist())")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, text=True,
                          capture_output=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.strip() == "[4.0, 4.0]", done.stderr


def test_given_day_reaches_the_scan(spark, tables):
    m = SalesModel(spark, tables, as_of="2001-08-01")
    scanned = SalesModel(spark, tables)
    plan = m.headers(90)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,2001-05-03T00:00)" in plan
    assert sorted(m.headers(90).collect()) == sorted(scanned.headers(90).collect())


EVENTS = "ts timestamp_ntz, kind string, value double"


def event_rows():
    at = dt.datetime(2024, 1, 1)
    return [(at + dt.timedelta(hours=3 * i), "ab"[i % 2], 1.0 + i % 5) for i in range(64)]


def stream_of(spark, folder, parts):
    rows = event_rows()
    size = len(rows) // parts
    for p in range(parts):
        spark.createDataFrame(rows[p * size:(p + 1) * size], EVENTS).coalesce(1) \
             .write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_totals_over_several_batches(spark, tmp_path):
    folder = str(tmp_path / "events")
    totals = alerts.daily_totals(stream_of(spark, folder, 4), "ts", "value", ["kind"])
    running, out = alerts.start_complete(totals, "t")
    running.awaitTermination()
    got = {(r.date, r.kind): (r.n_rows, float(r.total))
           for r in alerts.newest_batch(spark, out).collect()}
    want = {}
    for ts, kind, value in event_rows():
        n, v = want.get((ts.date(), kind), (0, 0.0))
        want[(ts.date(), kind)] = (n + 1, v + value)
    assert got == want


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_stream_alerts_on_closed_days_in_any_zone(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        folder = str(tmp_path / "events")
        baseline = spark.createDataFrame([("a", 100.0), ("b", 0.0)],
                                         "kind string, expected double")
        low = alerts.daily_alerts(stream_of(spark, folder, 2), baseline, "ts", "value",
                                  ["kind"])
        running, out = alerts.start_append(low, "a")
        running.awaitTermination()
        got = {(r.date, r.kind) for r in spark.read.parquet(out).collect()}
        # events end on day 7 at 21:00: days 0 to 5 closed before the watermark
        assert got == {(day(i), "a") for i in range(6)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_malformed_records_are_rejected_with_their_text(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text('product_name,quantity,revenue,customer_id,region,date\n'
                    'rod,2.0,5,c1,ASIA,2024-01-02\n'
                    'bar,1,5,c1,ASIA,2024-01-02,extra\n'
                    '"a\nb",3,5,c1,ASIA,2024-01-02\n'
                    'nut,x7,5,c1,ASIA,2024-01-02\n'
                    'pin,1,5\n')
    good, rejects = csv.load_sales(spark, str(path))
    assert sorted((r["product_name"], r["quantity"]) for r in good.collect()) == [
        ("a\nb", 3), ("rod", 2)]
    raw = {tuple(r["failed"]): r["raw"] for r in rejects.collect()}
    assert raw[("record_malformed",)] == "bar,1,5,c1,ASIA,2024-01-02,extra"
    assert "x7" in raw[("quantity_invalid",)] and len(raw) == 3


def test_large_csv_files_are_split_without_quoted_line_breaks(spark, tmp_path):
    sales, stock = tmp_path / "sales.csv", tmp_path / "stock.csv"
    sales.write_text("product_name,quantity,revenue,customer_id,region,date\n" +
                     "".join(f"p{i},1,2.5,c{i},north,2024-01-01\n" for i in range(2000)))
    stock.write_text("product_name,quantity_on_hand\n" +
                     "".join(f"p{i},{i}\n" for i in range(2000)))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "4096")
        for load, path in ((csv.load_sales, sales), (csv.load_inventory, stock)):
            good, rejects = load(spark, str(path), multi_line=False)
            assert good.rdd.getNumPartitions() > 1
            assert (good.count(), rejects.count()) == (2000, 0)
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_last_rows_read_the_needed_headers_only(spark, tables):
    m = SalesModel(spark, tables)
    every = {(r.date, r.total_sales) for r in m.daily_totals().collect()}
    newest = sorted(every, reverse=True)
    for n in (1, 30, 61, 10_000):
        got = {(r.date, r.total_sales) for r in m.daily_totals(last_rows=n).collect()}
        assert got <= every and set(newest[:n]) <= got
    since = newest[60][0]
    plan = m.daily_totals(since=since)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(o_orderdate,{since}T00:00)" in plan
    by_region = m.region_daily()
    want = {}
    for r in by_region.collect():
        want.setdefault(r.region, []).append((r.date, r.total_sales))
    got = {}
    for r in m.region_daily(last_rows=30).collect():
        got.setdefault(r.region, []).append((r.date, r.total_sales))
    assert set(got) == set(want)
    for region, rows in want.items():
        assert sorted(got[region], reverse=True)[:30] == sorted(rows, reverse=True)[:30]


def test_last_rows_go_back_past_days_without_lines(spark, tables, tmp_path):
    import shutil
    root = tmp_path / "t"
    root.mkdir()
    for name in ("orders", "part", "customer", "nation", "region"):
        shutil.copyfile(f"{tables}/{name}.parquet", root / f"{name}.parquet")
    recent = spark.read.parquet(f"{tables}/orders.parquet").where("o_orderdate >= '2000-01-01'")
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").join(
        recent, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    lines.coalesce(1).write.parquet(str(root / "lineitem.parquet"))
    m = SalesModel(spark, str(root))
    every = sorted(r.date for r in m.daily_totals().collect())
    got = sorted(r.date for r in m.daily_totals(last_rows=20).collect())
    assert got[-20:] == every[-20:] and every[-1] < dt.date(2000, 1, 1)

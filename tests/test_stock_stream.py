"""Stock kept by a stream: crossings reported once, late rows, replays, bounded state."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from merchlight.sources.versioned import VersionedTable
from merchlight.streaming import alerts, stock

MOVES = "product_id long, ts timestamp_ntz, kind string, quantity long, line long"
DAY0 = dt.datetime(2024, 1, 1)


def at(day, hour=12):
    return DAY0 + dt.timedelta(days=day, hours=hour)


def batches(spark, folder, *parts):
    """A stream that reads every part as a batch of its own."""
    for rows in parts:
        spark.createDataFrame(rows, MOVES).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(MOVES).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, folder, *parts, **more):
    query, table = stock.keep_stock(stock.stock_days(batches(spark, folder, *parts), **more))
    query.awaitTermination()
    return query, {(r["product_id"], (r["date"] - DAY0.date()).days): r
                   for r in table.read().collect()}


def steady(product, days, sold=2):
    return [(product, at(d), "sale", sold, d) for d in days]


def test_a_crossing_is_reported_once_until_it_recovers(spark, tmp_path):
    # 30 days of two units, then the stock falls through 20 and 15 days of supply
    rows = [(1, at(29, 1), "count", 50, 1), *steady(1, range(45)),
            (1, at(45), "receipt", 500, 0), *steady(1, range(46, 50)),
            (1, at(50), "count", 10, 0), (9, at(60), "sale", 1, 0)]
    _, days = run(spark, str(tmp_path / "m"), rows)
    alerts_of = {d: r["stock_alert"] for (p, d), r in days.items() if p == 1 and r["stock_alert"]}
    assert alerts_of == {35: "low", 40: "critical", 50: "critical"}
    assert days[1, 29]["stock"] == 50 and days[1, 30]["stock"] == 48
    assert days[1, 28]["stock"] is None and days[1, 28]["status"] is None
    assert days[1, 45]["stock"] == 20 + 500 and days[1, 45]["status"] == "healthy"


def test_a_drop_is_reported_once(spark, tmp_path):
    rows = [*steady(1, range(60), 10), *steady(1, range(60, 90), 4), (9, at(99), "sale", 1, 0)]
    _, days = run(spark, str(tmp_path / "m"), rows)
    dropped = [d for (p, d), r in days.items() if p == 1 and r["drop_alert"]]
    # 15 % are reached once more than 7.5 of 30 days have sold 4 in place of 10
    assert dropped == [67]
    assert days[1, 67]["change_pct"] == pytest.approx(-16) and days[1, 66]["change_pct"] == pytest.approx(-14)


def test_batches_do_not_change_the_closed_days(spark, tmp_path):
    rows = sorted([*steady(1, range(80)), *steady(2, range(0, 80, 3), 5),
                   (1, at(20, 9), "count", 40, 1), (2, at(31, 9), "count", 30, 1),
                   (2, at(31, 9), "count", 33, 2), (9, at(90), "sale", 1, 0)], key=lambda r: r[1])
    _, one = run(spark, str(tmp_path / "a"), rows)
    _, many = run(spark, str(tmp_path / "b"), *[rows[i:i + 30] for i in range(0, len(rows), 30)])
    assert one == many
    assert one[2, 33]["stock"] == 33 - 5            # of two counts at a time the later line


def test_late_rows_are_counted_and_old_ones_dropped(spark, tmp_path):
    first = [*steady(1, range(10)), (2, at(0), "sale", 3, 0)]
    second = [(1, at(12), "sale", 1, 0)]
    # day 8 has closed (newest is day 12), and lies within four days; day 1 does not
    third = [(1, at(8), "sale", 100, 0), (1, at(8), "sale", 100, 1), (1, at(1), "sale", 7, 0),
             (1, at(11), "sale", 6, 0)]
    query, days = run(spark, str(tmp_path / "m"), first, second, third, [(1, at(20), "sale", 1, 0)],
                      delay=1, grace=4)
    assert days[1, 8]["late_rows"] == 2 and days[1, 8]["units"] == 2
    assert days[1, 8]["mean_demand"] == pytest.approx(18 / 30)
    assert days[1, 1]["units"] == 2 and days[1, 1]["late_rows"] == 0
    assert days[1, 11]["units"] == 6 and days[1, 11]["closed"]
    dropped = sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress)
    assert dropped == 1


def test_state_is_one_value_a_product_and_bounded(spark, tmp_path):
    rows = steady(1, range(400))
    query, days = run(spark, str(tmp_path / "m"), *[rows[i:i + 100] for i in range(0, 400, 100)])
    assert len(days) == 400
    assert all(p.stateOperators[0].numRowsTotal <= 1 for p in query.recentProgress)
    keeper = stock.StockKeeper(1, 3)
    held = {}

    class Value:
        def get(self):
            return held.get("v")

        def update(self, v):
            held["v"] = v

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 400 * stock.DAY_MS

    class Handle:
        def registerTimer(self, ms):
            held["timer"] = ms

    keeper.state, keeper.handle = Value(), Handle()
    keeper.state.update((None, 0, False, [(d, 1, 2, -2, None, None, None, False, 0)
                                          for d in range(500)]))
    out = list(keeper.handleExpiredTimer((1,), Clock(), None))
    assert len(out) == 402                          # days 0 to 401 are closed
    kept = [d for d, *_ in held["v"][3]]
    assert min(kept) == 401 - stock.KEPT_DAYS + 1 and max(kept) == 499
    assert held["timer"] == keeper.closes_at(402) - 1


def test_a_batch_without_late_rows_is_written_once(spark, tmp_path):
    """Only late rows are grouped and set aside again; the table is the same with them."""
    import os
    rows = [*steady(1, range(10)), *steady(2, range(8), 3)]
    query, table = stock.keep_stock(stock.stock_days(batches(
        spark, str(tmp_path / "m"), rows, [(1, at(13), "sale", 1, 0)],
        [(1, at(10), "sale", 5, 0), (2, at(9), "sale", 5, 0), (1, at(12), "sale", 4, 0)],
        [(1, at(20), "sale", 1, 0)])), path=str(tmp_path / "t"))
    query.awaitTermination()
    written = {v: os.path.exists(f"{tmp_path}/t/incoming/version={v}") for v in table.versions()}
    assert not written[0] and sum(written.values()) == 1
    days = [(r["product_id"], (r["date"] - DAY0.date()).days) for r in table.read().collect()]
    assert len(days) == len(set(days)) == 23
    late = {k: v for k, v in zip(days, [r["late_rows"] for r in table.read().collect()]) if v}
    assert late == {(1, 10): 1, (2, 9): 1}


def test_old_versions_go_and_days_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stock, "KEPT_VERSIONS", 2)
    rows = steady(1, range(30))
    query, table = stock.keep_stock(stock.stock_days(batches(
        spark, str(tmp_path / "m"), *[rows[i:i + 10] for i in range(0, 30, 10)])))
    query.awaitTermination()
    assert len(table.versions()) <= 3 and table.read().count() == 30
    _, days = run(spark, str(tmp_path / "n"), rows)
    assert {(r["product_id"], (r["date"] - DAY0.date()).days): r for r in table.read().collect()} == days


def test_odd_rows_are_left_out(spark, tmp_path):
    rows = [(None, at(0), "sale", 1, 0), (1, None, "sale", 1, 0), (1, at(0), "sale", None, 0),
            (1, at(0), "gift", 5, 0), (1, at(0), None, 5, 0), (1, at(0), "sale", 4, None)]
    _, days = run(spark, str(tmp_path / "m"), rows)
    assert {k: (r["units"], r["n_rows"], r["closed"]) for k, r in days.items()} == {(1, 0): (4, 1, False)}


def test_days_are_those_of_the_given_times_in_any_zone(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = [(1, at(d, 23), "sale", 2, d) for d in range(20)]
        _, days = run(spark, str(tmp_path / "m"), rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {(d, r["units"], r["closed"]) for (_, d), r in days.items()} == {
        (d, 2, d < 18) for d in range(20)}


def test_grace_must_cover_the_delay(spark, tmp_path):
    with pytest.raises(ValueError):
        stock.stock_days(batches(spark, str(tmp_path / "m"), steady(1, [0])), delay=3, grace=2)


# -- tables that are replaced part by part ----------------------------------------------

TABLE = "id long, v string, month string"


def rows_of(table, **more):
    return sorted((r["month"], r["id"] is None, r["id"] or 0, r["v"]) for r in table.read(**more).collect())


def test_upsert_replaces_by_key_and_keeps_the_rest(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), TABLE)
    make = lambda rows: spark.createDataFrame(rows, TABLE)
    assert rows_of(table) == []
    table.upsert(make([(1, "a", "2024-01"), (2, "b", "2024-01"), (None, "n", "2024-02")]), 0, ["id"])
    changed = make([(2, "B", "2024-01"), (None, "N", "2024-02"), (3, "c", "2024-03")])
    assert table.upsert(changed, 1, ["id"]) == ["2024-01", "2024-02", "2024-03"]
    want = [("2024-01", False, 1, "a"), ("2024-01", False, 2, "B"), ("2024-02", True, 0, "N"),
            ("2024-03", False, 3, "c")]
    assert rows_of(table) == want
    table.upsert(changed, 1, ["id"])                # a replay of the same version
    assert rows_of(table) == want and table.versions() == [0, 1]
    table.upsert(make([(4, "d", "2024-03")]), 2, ["id"])
    assert rows_of(table, parts=["2024-03"]) == [("2024-03", False, 3, "c"), ("2024-03", False, 4, "d")]
    table.vacuum(keep=1)
    assert table.versions() == [2] and len(rows_of(table)) == 5


def test_readers_do_not_see_half_a_write(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), TABLE)
    table.replace(spark.createDataFrame([(1, "a", "2024-01")], TABLE), 0)
    # a writer that fails after its data and before its manifest
    spark.createDataFrame([(1, "x", "2024-01")], TABLE).write.partitionBy("month").parquet(
        f"{table.path}/data/version=1")
    assert rows_of(table) == [("2024-01", False, 1, "a")]
    table.replace(spark.createDataFrame([(1, "y", "2024-01")], TABLE), 1)
    assert rows_of(table) == [("2024-01", False, 1, "y")]
    with pytest.raises(Exception, match="a row has no month"):
        table.replace(spark.createDataFrame([(1, "z", None)], TABLE), 2)
    assert rows_of(table) == [("2024-01", False, 1, "y")]


def test_totals_are_updated_by_batch(spark, tmp_path):
    folder = str(tmp_path / "m")
    moves = batches(spark, folder, steady(1, range(5)), steady(1, range(3, 8)))
    query, table = alerts.start_update(
        alerts.daily_totals(moves, "ts", "quantity", ["product_id"]), ["product_id"], "t")
    query.awaitTermination()
    got = {(r["date"] - DAY0.date()).days: (r["n_rows"], float(r["total"])) for r in table.read().collect()}
    assert got == {0: (1, 2.0), 1: (1, 2.0), 2: (1, 2.0), 3: (2, 4.0), 4: (2, 4.0),
                   5: (1, 2.0), 6: (1, 2.0), 7: (1, 2.0)}
    assert table.read().where(F.col("month") != "2024-01").count() == 0


def test_stored_orders_write_changed_months_only(spark, tables, tmp_path):
    import shutil

    from merchlight.plans.model import SalesModel
    root = tmp_path / "tables"
    shutil.copytree(tables, root)
    (root / "orders.parquet").chmod(0o644)
    m = SalesModel(spark, str(root))
    table = m.stored_orders(str(tmp_path / "fact"))
    first = m.refresh_orders(table)
    want = lambda: sorted(map(tuple, m.order_totals().select(
        "order_id", "customer_id", "date", "sale_rows", "quantity", "revenue").collect()))
    got = lambda: sorted(tuple(r)[:6] for r in table.read().collect())
    assert len(first) > 50 and got() == want() and table.versions() == [0]
    assert m.refresh_orders(table) == [] and table.versions() == [0]
    # one order moves to another day of its month, and all orders of one month go
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    row = orders.where("o_orderdate >= '1997-05-01' AND o_orderdate < '1997-05-20'").first()
    changed = orders.where("o_orderdate < '1996-02-01' OR o_orderdate >= '1996-03-01'").withColumn(
        "o_orderdate", F.when(F.col("o_orderkey") == row["o_orderkey"],
                              F.expr("o_orderdate + INTERVAL 3 DAY")).otherwise(F.col("o_orderdate")))
    changed.coalesce(1).write.parquet(str(tmp_path / "new"))
    file = next((tmp_path / "new").glob("part-*.parquet"))
    shutil.copyfile(file, root / "orders.parquet")
    spark.catalog.clearCache()
    m = SalesModel(spark, str(root))
    assert m.refresh_orders(table) == ["1997-05"] and table.versions() == [0, 1]
    assert got() == want()
    assert "1996-02" not in {r["month"] for r in table.manifest()}


def test_a_call_gives_one_packed_row(spark, tmp_path):
    class Value:
        def __init__(self):
            self.held = None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        def getValueState(self, name, schema):
            return value

        def registerTimer(self, ms):
            pass

    class Clock:
        def __init__(self, day):
            self.day = day

        def getCurrentWatermarkInMs(self):
            return self.day * stock.DAY_MS

    value, keeper = Value(), stock.PackedKeeper(1, 3)
    keeper.init(Handle())
    kind = stock.SUMS_PACKED.names
    days = [dict(day=d, n_rows=1, sold=2, net=-2, counted=0, counted_at=0, counted_line=0, known=False)
            for d in range(100)]
    days[5] |= dict(counted=0, counted_at=7, counted_line=3, known=True)
    sums = [type("R", (), {"sums": x.as_py()}) for x in stock.packed_rows(
        len(days), stock.SUMS_PACKED, {c: [d[c] for d in days] for c in kind})]

    def table(rows):
        rows = list(rows)
        assert len(rows) == 1                       # a product's days are one value
        batch = pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in (
            ("product_id", pa.int64()), ("days", pa.binary()))], names=["product_id", "days"])
        return pa.Table.from_batches(stock.unpacked(iter([batch]))).to_pylist()

    opened = table(keeper.handleInputRows((4,), iter(sums), Clock(-9)))
    assert len(opened) == 100 and opened[9] == dict.fromkeys(opened[9]) | {
        "product_id": 4, "date": dt.date(1970, 1, 10), "closed": False, "n_rows": 1, "units": 2,
        "late_rows": 0}
    assert len(value.held) == 1 and isinstance(value.held[0], bytes)
    closed = table(keeper.handleExpiredTimer((4,), Clock(90), None))
    assert len(closed) == 92 and [r["stock"] for r in closed[4:8]] == [None, 0, -2, -4]
    assert closed[5]["stock_alert"] == closed[5]["status"] == "critical"
    assert closed[80]["mean_demand"] == 2 and closed[80]["change_pct"] == 0
    late = table(keeper.handleInputRows((4,), iter(sums[80:81]), Clock(90)))
    assert late == [dict.fromkeys(late[0]) | {"product_id": 4, "date": dt.date(1970, 3, 22),
                                              "closed": True, "late_rows": 1}]

"""CSV records over many tasks: quote states, fragments, headers in any order."""

import csv as reader
import io

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from merchlight.plans.model import SalesModel
from merchlight.sources import csv, records


def split(text):
    """The records of a text, line by line in one go; one left open loses the last line's end."""
    inside, held, out = False, [], []
    for line in text.removesuffix("\n").split("\n"):
        if not held and not line.strip():
            continue
        held.append(line)
        inside = records.ends_inside(line, inside)
        if not inside:
            out.append("\n".join(held))
            held = []
    return out + (["\n".join(held)] if held else [])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='ab",\n" ', max_size=40))
def test_lines_join_to_the_records_of_the_csv_module(text):
    inside = False
    for line in text.split("\n"):
        inside = records.ends_inside(line, inside)
    text += '"' * inside                        # the end of the text closes its last field
    want = [r for r in reader.reader(io.StringIO(text, newline="")) if r and r != [""] and "".join(r).strip()]
    got = [records.parse(r) for r in split(text)]
    assert [r for r in got if "".join(r).strip()] == want


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "64")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def read(spark, folder):
    found, headers = records.read_records(spark, str(folder))
    return sorted((r["file"].rsplit("/", 1)[1], r["raw"], r["fields"], r["whole"])
                  for r in found.collect()), headers


def test_records_over_many_blocks(spark, tmp_path, small_blocks):
    import random
    draw, want = random.Random(7), []
    for k in range(4):
        body = "".join(draw.choice('ab",\n" ') for _ in range(900))
        text = f"x,y\n{body}\n"
        (tmp_path / f"{k}.csv").write_text(text)
        for raw in split(text)[1:]:
            fields = records.parse(raw)
            want.append((f"{k}.csv", raw, fields, len(fields) == 2))
    assert records.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 30
    got, headers = read(spark, tmp_path)
    assert got == sorted(want) and headers == [["x", "y"]]


def test_a_field_longer_than_many_blocks(spark, tmp_path, small_blocks):
    long = "line\n" * 200
    (tmp_path / "a.csv").write_text(f'x,y\n1,"{long}"\n2,"b"\n3,"never closed\n4,5\n')
    got, _ = read(spark, tmp_path)
    assert [r[2] for r in got] == [["1", long], ["2", "b"], ["3", "never closed\n4,5"]]


def test_headers_marks_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,n\r\nrod,1\r\n\r\n\"a\r\nb\",2\r\n".encode())
    (tmp_path / "b.csv").write_text('n,"na""me",name\n3,x,bolt\n')
    (tmp_path / "c.csv").write_text("name,n\n")
    (tmp_path / "d.csv").write_text("")
    got = csv.read_text_table(spark, str(tmp_path))
    assert set(got.columns) == {"name", "n", 'na"me', "_record", "_raw"}
    assert sorted((r["name"], r["n"]) for r in got.collect()) == [
        ("a\r\nb", "2"), ("bolt", "3"), ("rod", "1")]
    assert got.where(F.col('na"me') == "x").count() == 1


def test_changed_splits_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    plan = records.learn_plan(records.lines_of(spark, str(tmp_path)))
    file = records.lines_of(spark, str(tmp_path)).first()["file"]
    assert plan.begins_inside(file, 0) is False
    with pytest.raises(RuntimeError, match="splits changed"):
        plan.begins_inside(file, 64)


def test_counts_fit_the_stock_position(spark, tables, tmp_path):
    m = SalesModel(spark, tables)
    name = m.products().where("product_id = 3").first()["product_name"]
    (tmp_path / "i.csv").write_text(f"quantity_on_hand,product_name\n7,{name}\n9,unknown\n-1,{name}\n")
    good, rejects = csv.load_inventory(spark, str(tmp_path))
    assert [r["raw"] for r in rejects.collect()] == [f"-1,{name}"]
    counts = csv.stock_counts(good, m.products(), "2001-08-01")
    same = [r[0] for r in m.products().where(F.col("product_name") == name).select("product_id").collect()]
    assert sorted((r["product_id"], r["quantity_on_hand"], str(r["last_updated"]))
                  for r in counts.collect()) == [(i, 7, "2001-08-01") for i in sorted(same)]
    assert csv.unknown_products(good, m.products()).count() == 1
    daily = csv.read_daily_metrics  # both readers give the same daily table
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "d.csv").write_text("date,total_sales,inventory_level,revenue,customers\n"
                                          "2024-01-02,1,2,3,4\n2024-01-01,5,6,7,8\n")
    path = str(tmp_path / "d")
    assert daily(spark, path).collect() == daily(spark, path, multi_line=False).collect()

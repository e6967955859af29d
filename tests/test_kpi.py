import pytest

from merchlight.operators import kpi
from tests.conftest import day

SALES = "date date, sale_rows bigint, quantity bigint, revenue decimal(18,4), customer_id int"
PRODUCTS = "product_id int, product_name string, revenue decimal(18,4)"


def sales(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([(d, n, q, Decimal(r), c) for d, n, q, r, c in rows], SALES)


def products(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([(i, n, Decimal(r)) for i, n, r in rows], PRODUCTS)


def test_empty_tables(spark):
    got = kpi.kpi_summary(sales(spark, []), products(spark, [])).first()
    assert got.asDict() == {"total_revenue": 0, "total_sales_quantity": 0,
                            "avg_order_value": 0, "top_product": "N/A",
                            "revenue_growth_pct": 0}
    context = kpi.business_context(sales(spark, []), products(spark, [])).first()
    assert context.top_products == [] and context.recent_share_pct == 0


def test_calendar_windows(spark):
    # as_of - 30 still counts as recent, as_of - 31 and as_of - 60 as previous
    rows = [(day(100), 1, 1, "10", 1), (day(70), 1, 1, "20", 1), (day(69), 1, 1, "5", 1),
            (day(40), 1, 1, "5", 1), (day(39), 1, 1, "1000", 1)]
    got = kpi.kpi_summary(sales(spark, rows), products(spark, [])).first()
    assert got.revenue_growth_pct == 200
    assert got.total_revenue == 1040 and got.avg_order_value == 208


def test_same_name_products_stay_apart(spark):
    table = products(spark, [(3, "rod", "6"), (1, "rod", "6"), (2, "bolt", "10")])
    got = [(r.product_id, r.product_name) for r in kpi.top_products(table, 3).collect()]
    assert got == [(2, "bolt"), (1, "rod"), (3, "rod")]


def test_context_extras_and_shares(spark):
    rows = [(day(100), 1, 1, "30", 1), (day(1), 2, 1, "70", 2)]
    got = kpi.business_context(sales(spark, rows), products(spark, [(1, "rod", "100")]),
                               extra={"note": "x"}).first()
    assert got.recent_share_pct == 30 and got.extra == {"note": "x"}
    assert [p.name for p in got.top_products] == ["rod"]


def test_profit_columns(spark):
    got = kpi.with_profit(sales(spark, [(day(0), 1, 1, "50", 1), (day(0), 1, 1, "0", 1)]))
    first, zero = got.orderBy("revenue", ascending=False).collect()
    assert (first.cost, first.profit, first.profit_margin) == (30, 20, 40)
    assert zero.profit_margin is None


def test_dataset_stats_approx(spark):
    rows = [(day(i), 1, 1, "1", i % 5) for i in range(20)]
    table = sales(spark, rows)
    exact = kpi.dataset_stats(table, products(spark, [(1, "a", "1")])).first()
    about = kpi.dataset_stats(table, products(spark, [(1, "a", "1")]), approx=True).first()
    assert exact == about
    assert (exact.customers, exact.products, exact.sale_rows) == (5, 1, 20)


def test_breakdown_shares_add_up(spark):
    rows = [(day(i), 1, 1, str(i + 1), i % 3) for i in range(9)]
    table = sales(spark, rows).withColumnRenamed("customer_id", "region")
    got = kpi.revenue_by_region(table).collect()
    assert sum(r.share_pct for r in got) == pytest.approx(100)

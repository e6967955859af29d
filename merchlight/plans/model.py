"""The star tables as sales facts, each at the cheapest grain for its reader.

Joins carry no broadcast hints: Spark broadcasts a side only below its size
threshold, and splits skewed partitions of the others at run time. Sale lines
are added up before they are joined wherever the reader allows it, so that one
order, product or customer with a large share of all lines is reduced to a
single row per map task before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from merchlight.functions.measures import exact_total, ratio, ten_thousandths
from merchlight.functions.running import running_before
from merchlight.session import shared_dir, stage
from merchlight.sources.sinks import with_month
from merchlight.sources.versioned import VersionedTable

# Product categories of the part table, the day the daily stock
# rule counts from, and the reorder level of every product.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CATEGORY_COLUMNS = [f"{c.lower()}_sales" for c in CATEGORIES]
STOCK_EPOCH = "1995-01-01"
REORDER_LEVEL = 10
# A word of a turn.
WORD = r"[^\x20\x09-\x0D]+"


#: Derived questions: what stands before and after a product's name.
PRODUCT_QUESTIONS = [
    ("Why does ", " sell less?"), ("Can you PREDICT ", " for the next weeks?"),
    ("Does our Inventory of ", " last?"), ("What would you recommend for ", "?"),
    ("Tell me about ", "."), ("Will ", " Decrease further, and what of its future?")]


class SalesModel:
    """Reads ``<root>/<table>.parquet`` and derives the sales facts.

    ``as_of`` is the reference day; by default the last order date, found by a scan
    of that one column. A given day saves the scan and prunes at planning time.
    """

    def __init__(self, spark: SparkSession, root: str, as_of: str | None = None):
        self.spark, self.root, self.day = spark, root.rstrip("/"), as_of
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:       # the footer is read once per table
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    def as_of(self) -> Column:
        """The reference day: given, or a scalar subquery over the order dates."""
        if self.day is not None:
            return F.lit(self.day).cast("date")
        return self.table("orders").agg(
            F.max("o_orderdate").cast("date").alias("as_of")).scalar()

    # -- line and header grain -------------------------------------------------

    def lines(self) -> DataFrame:
        """Sale lines; ``revenue_e4`` is the revenue in ten-thousandths, for sums."""
        price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
        revenue = price * (1 - F.col("l_discount"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            quantity.cast("bigint").alias("quantity"),
            ratio(price, quantity).alias("unit_price"),
            revenue.cast("decimal(18,4)").alias("revenue"),
            ten_thousandths(revenue).alias("revenue_e4"))

    def _since(self, days: int) -> Column:
        if self.day is not None:
            return F.date_sub(F.lit(self.day).cast("date"), days).cast("timestamp_ntz")
        return self.table("orders").agg(
            F.date_sub(F.max("o_orderdate").cast("date"), days)
            .cast("timestamp_ntz").alias("bound")).scalar()

    def headers(self, last_days: int | None = None, since=None) -> DataFrame:
        """Order id, customer and date; ``last_days`` keeps ``as_of - days`` and later,
        ``since`` a given date and later.

        The bound is one value compared with the stored column, as scan filters need
        it. Parquet skips row groups by dates and numbers; for the zone-less
        timestamps of these tables Spark 4.1 filters the rows it has read.
        """
        orders = self.table("orders")
        if last_days is not None:
            orders = orders.filter(F.col("o_orderdate") >= self._since(last_days))
        if since is not None:
            orders = orders.filter(F.col("o_orderdate") >=
                                   F.lit(str(since)).cast("date").cast("timestamp_ntz"))
        return orders.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("date"))

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.lit(REORDER_LEVEL).cast("bigint").alias("reorder_level"))

    def customer_regions(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        region = self.table("region").select("r_regionkey", F.col("r_name").alias("region"))
        places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(
            places, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(F.col("c_custkey").alias("customer_id"), "region")

    def sales_fact(self, last_days: int | None = None) -> DataFrame:
        """One row per sale line with date, product, category, customer and region."""
        buyers = self.headers(last_days).join(self.customer_regions(), "customer_id")
        products = self.products().drop("reorder_level")
        return self.lines().join(products, "product_id").join(buyers, "order_id").select(
            "date", "order_id", "product_id", "product_name", "category", "customer_id",
            "region", "quantity", "unit_price", "revenue")

    def unmatched_lines(self) -> DataFrame:
        """Why sale lines are no row of ``sales_fact``: reason, lines and their revenue.

        The joins of the fact are inner ones; a line without header, product or buyer's
        region is counted here, by the first of these that it lacks.
        """
        keys = {"order": (self.headers().select("order_id", "customer_id"), "order_id"),
                "product": (self.products().select("product_id"), "product_id"),
                "region": (self.customer_regions().select("customer_id"), "customer_id")}
        lines = self.lines()
        for name, (table, key) in keys.items():
            lines = lines.join(table.withColumn(f"has_{name}", F.lit(True)), key, "left")
        missing = F.when(F.col("has_order").isNull(), "order") \
            .when(F.col("has_product").isNull(), "product") \
            .when(F.col("has_region").isNull(), "region").otherwise("none")
        return lines.groupBy(missing.alias("missing")).agg(
            F.count("*").alias("sale_rows"), exact_total("revenue_e4").alias("revenue"))

    # -- added-up grains ---------------------------------------------------------

    def order_totals(self, last_days: int | None = None, since=None) -> DataFrame:
        """One row per order: lines are added up by order before the header join,
        which then runs on the partitioning the aggregate left behind. With bounds
        the few headers come first, and other orders' lines are not added up."""
        if since is not None or last_days is not None:
            dated = self.lines().join(self.headers(last_days, since), "order_id")
            return dated.groupBy("order_id", "customer_id", "date").agg(
                F.count("*").alias("sale_rows"), F.sum("quantity").alias("quantity"),
                exact_total("revenue_e4").alias("revenue"))
        totals = self.lines().groupBy("order_id").agg(
            F.count("*").alias("sale_rows"), F.sum("quantity").alias("quantity"),
            exact_total("revenue_e4").alias("revenue"))
        return totals.join(self.headers(), "order_id")

    def both_totals(self) -> tuple[DataFrame, DataFrame]:
        """``daily_totals`` and ``product_totals`` from one scan of the lines.

        Lines are added up by order and by product side by side, each in its map tasks
        before the shuffle, and the sums are written once for both readers.
        """
        sums = stage(self.lines().groupingSets(
            [["order_id"], ["product_id"]], "order_id", "product_id").agg(
            F.grouping("order_id").alias("by_product"), F.count("*").alias("sale_rows"),
            F.sum("quantity").alias("quantity"), exact_total("revenue_e4").alias("revenue")), "totals")
        orders = sums.where("by_product = 0").drop("by_product", "product_id")
        products = sums.where("by_product = 1").drop("by_product", "order_id")
        return (self._daily(orders.join(self.headers(), "order_id")),
                products.join(self.products(), "product_id"))

    def product_totals(self) -> DataFrame:
        """One row per sold product; order headers are not needed for it."""
        totals = self.lines().groupBy("product_id").agg(
            F.count("*").alias("sale_rows"), F.sum("quantity").alias("quantity"),
            exact_total("revenue_e4").alias("revenue"))
        return totals.join(self.products(), "product_id")

    def all_product_totals(self) -> DataFrame:
        """One row per product, 0 for those that never sold."""
        totals = self.product_totals().select("product_id", "sale_rows", "quantity", "revenue")
        return self.products().join(totals, "product_id", "left").fillna(0, ["sale_rows", "quantity"]) \
            .withColumn("revenue", F.coalesce("revenue", F.lit(0).cast("decimal(38,4)")))

    def region_totals(self) -> DataFrame:
        """Per customer first, so a dominant customer joins as one row."""
        per_customer = self.order_totals().groupBy("customer_id").agg(
            F.sum("sale_rows").alias("sale_rows"), F.sum("quantity").alias("quantity"),
            F.sum("revenue").alias("revenue"))
        return per_customer.join(self.customer_regions(), "customer_id")

    def last_rows(self, n: int, build, keys: Sequence[str] = ()) -> DataFrame:
        """At least the last ``n`` dates with sales (of every region, if a key).

        The n-th newest order date bounds the headers before any line is joined; it
        comes from one column, as one row for each date. Dates whose orders have no
        line are no rows, so if rows are missing the bound goes back four times as many
        dates, until it is the first. The result is one row a date and key, written.
        """
        dates = self.table("orders").select(
            F.col("o_orderdate").cast("date").alias("date")).where("date IS NOT NULL").distinct()
        groups = self.table("region").count() if keys else 1
        want = n
        while True:
            bound = dates.orderBy(F.desc("date")).limit(want).agg(
                F.min("date").alias("since"), F.count("*").alias("dates")).first()
            found = stage(build(bound["since"]), "last-rows")
            if bound["dates"] < want:
                return found
            full = found.groupBy(*keys).count().where(F.col("count") >= n).count()
            if full >= groups:
                return found
            want *= 4

    def daily_totals(self, last_days: int | None = None, last_rows: int | None = None,
                     since=None) -> DataFrame:
        """One row per date, with the derived stock level of that day; ``last_rows``
        keeps at least that many newest ones."""
        if last_rows is not None:
            return self.last_rows(last_rows, lambda d: self.daily_totals(since=d))
        return self._daily(self.order_totals(last_days, since))

    @staticmethod
    def _daily(orders: DataFrame) -> DataFrame:
        daily = orders.groupBy("date").agg(
            F.sum("sale_rows").alias("sale_rows"), F.count("*").alias("orders"),
            F.sum("quantity").alias("total_sales"), F.sum("quantity").alias("quantity"),
            F.sum("revenue").alias("revenue"))
        return daily.withColumn("inventory_level", stock_level())

    def order_metrics(self, since=None) -> DataFrame:
        """One row per order with its units split by category.

        The split happens while lines are added up, so the joins above it and the
        distinct customers work on orders, not on lines. With ``since`` the few headers
        are joined first.
        """
        lines, by = self.lines(), ["order_id"]
        if since is not None:
            lines, by = lines.join(self.headers(since=since), "order_id"), \
                ["order_id", "customer_id", "date"]
        items = lines.join(self.products().select("product_id", "category"), "product_id")
        orders = items.groupBy(*by).agg(
            F.sum("quantity").alias("quantity"), exact_total("revenue_e4").alias("revenue"),
            *[F.sum(F.when(F.col("category") == c, F.col("quantity")).otherwise(0)).alias(n)
              for c, n in zip(CATEGORIES, CATEGORY_COLUMNS)])
        return orders if since is not None else orders.join(self.headers(), "order_id")

    def daily_metrics(self, last_rows: int | None = None, since=None) -> DataFrame:
        """The wide daily table: totals, stock, customers, one column per category."""
        if last_rows is not None:
            return self.last_rows(last_rows, lambda d: self.daily_metrics(since=d))
        return _by_day(self.order_metrics(since))

    def region_metrics(self, last_rows: int | None = None, since=None) -> DataFrame:
        """The wide daily table per region."""
        if last_rows is not None:
            return self.last_rows(last_rows, lambda d: self.region_metrics(since=d), ["region"])
        orders = self.order_metrics(since).join(self.customer_regions(), "customer_id")
        return _by_day(orders, "region")

    def category_daily(self) -> DataFrame:
        """(date, category, sales) in units."""
        items = self.lines().join(self.products().select("product_id", "category"),
                                  "product_id").join(self.headers(), "order_id")
        return items.groupBy("date", "category").agg(F.sum("quantity").alias("sales"))

    def region_daily(self, last_rows: int | None = None, since=None) -> DataFrame:
        """One row per region and date; ``last_rows`` keeps at least that many newest of each."""
        if last_rows is not None:
            return self.last_rows(last_rows, lambda d: self.region_daily(since=d), ["region"])
        orders = self.order_totals(since=since).join(self.customer_regions(), "customer_id")
        daily = orders.groupBy("region", "date").agg(
            F.sum("sale_rows").alias("sale_rows"), F.count("*").alias("orders"),
            F.sum("quantity").alias("total_sales"), F.sum("revenue").alias("revenue"))
        return daily.withColumn("inventory_level", stock_level())

    def dated_lines(self, last_days: int | None = None) -> DataFrame:
        """Sale lines with their date, all or of the last days."""
        return self.lines().join(self.headers(last_days), "order_id")

    def product_daily(self, last_days: int | None = None) -> DataFrame:
        """One row per product and date with a sale, of all or the last days."""
        return self.dated_lines(last_days).groupBy("product_id", "date").agg(
            F.sum("quantity").alias("quantity"), exact_total("revenue_e4").alias("revenue"))

    def stock_snapshots(self) -> DataFrame:
        """Stock counts per product over time: every shipment leaves a count,
        set by a fixed rule on its order and line."""
        return self.table("lineitem").select(
            F.col("l_partkey").alias("product_id"),
            (10 + (F.col("l_orderkey") * 37 + F.col("l_linenumber")) % 190)
            .cast("int").alias("quantity_on_hand"),
            F.col("l_shipdate").cast("date").alias("last_updated"))

    def new_customers_daily(self) -> DataFrame:
        """Customers by the day of their first order."""
        first = self.headers().where("customer_id IS NOT NULL AND date IS NOT NULL") \
            .groupBy("customer_id").agg(F.min("date").alias("date"))
        return first.groupBy("date").agg(F.count("*").alias("customers"))

    def in_transit(self) -> DataFrame:
        """Deliveries due after the reference day: by a fixed rule, the first lines of
        orders that ship later bring their quantity on that day."""
        lines = self.table("lineitem").where(F.col("l_linenumber") == 1)
        return lines.select(
            F.col("l_partkey").alias("product_id"), F.col("l_shipdate").cast("date").alias("ds"),
            F.col("l_quantity").cast("bigint").alias("quantity")).where(F.col("ds") > self.as_of())

    def movement_stream(self) -> DataFrame:
        """Stock movements by product as a stream over the sale lines.

        A fixed rule makes the first line of an order a stock count (as in
        ``stock_snapshots``), returned lines receipts, and the others sales.
        """
        lines = self.spark.readStream.schema(self.table("lineitem").schema) \
                    .option("pathGlobFilter", "lineitem.parquet").parquet(self.root)
        counted = F.col("l_linenumber") == 1
        return lines.select(
            F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("ts"),
            F.when(counted, "count").when(F.col("l_returnflag") == "R", "receipt")
            .otherwise("sale").alias("kind"),
            F.when(counted, 10 + (F.col("l_orderkey") * 37 + 1) % 190)
            .otherwise(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.col("l_orderkey").alias("line"))

    # -- the stored fact -----------------------------------------------------------

    def stored_orders(self, path: str | None = None) -> VersionedTable:
        """Order totals by month; by default in a folder of the shared one for this model."""
        named = hashlib.sha256(self.root.encode()).hexdigest()[:16]
        return VersionedTable(
            self.spark, path or f"{shared_dir(self.spark)}/merchlight/orders-by-month-{named}",
            "order_id long, customer_id long, date date, sale_rows long, quantity long, "
            "revenue decimal(38,4), month string", notes="n_orders long, mark long")

    def refresh_orders(self, table: VersionedTable) -> list[str]:
        """Bring the stored fact up to date; the months written.

        A month's number of orders and a mark of their ids, customers and dates, from
        the headers alone, are compared with those in the table's manifest; only the
        months that differ are joined with lines and written, as one new version. An
        order's lines are taken to come with it: changed lines of old headers go
        unseen. Orders without a date are left out, months without orders dropped.
        """
        headers = with_month(self.headers().where("date IS NOT NULL"))
        marks = headers.groupBy("month").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("order_id", "customer_id", "date"))
            .alias("mark")).collect()                       # one row a month
        now = {r["month"]: (r["n"], r["mark"]) for r in marks}
        known = {r["month"]: (r["n_orders"], r["mark"]) for r in table.manifest()}
        changed = sorted(m for m in now if known.get(m) != now[m])
        gone = sorted(set(known) - set(now))
        if not changed and not gone:
            return []
        first, last = (min(changed), max(changed)) if changed else ("9999-12", "9999-12")
        end = F.add_months(F.to_date(F.lit(f"{last}-01")), 1)
        whole = len(changed) == len(now)
        totals = self.order_totals() if whole else self.order_totals(since=f"{first}-01") \
            .where(F.col("date") < end)
        rows = with_month(totals.where("date IS NOT NULL")).where(F.col("month").isin(changed))
        versions = table.versions()
        table.replace(rows, versions[-1] + 1 if versions else 0, [*gone, *changed], now)
        return changed

    # -- questions and events ----------------------------------------------------

    def questions(self, history_tokens: int | None = None) -> DataFrame:
        """Questions asked: every user turn of the conversations.

        ``history_tokens`` adds ``history``: the turns before, oldest first, as many of
        the newest as hold so many tokens together (see ``chat_history``).
        """
        turns = self.table("conversations")
        said = turns.filter(F.col("role") == "user").select(
            "conv_id", "turn", F.concat_ws("-", F.lit("turn"), "conv_id", "turn")
            .alias("question_id"), F.col("text").alias("question"))
        if history_tokens is not None:
            said = said.join(chat_history(turns, history_tokens), ["conv_id", "turn"], "left")
        return said.drop("conv_id", "turn")

    def product_questions(self) -> DataFrame:
        """A question about every product, worded by a fixed rule on its id."""
        name = F.col("product_name")
        texts = [F.concat(F.lit(a), name, F.lit(b)) for a, b in PRODUCT_QUESTIONS]
        return self.products().select(
            F.concat(F.lit("product-"), "product_id").alias("question_id"),
            F.get(F.array(*texts), F.pmod("product_id", F.lit(len(texts))).cast("int"))
            .alias("question"))

    def event_stream(self) -> DataFrame:
        """The event files as a stream."""
        schema = self.table("events").schema
        return self.spark.readStream.schema(schema) \
                   .option("pathGlobFilter", "events.parquet").parquet(self.root)


def chat_history(turns: DataFrame, tokens: int) -> DataFrame:
    """The history of every turn of (conv_id, turn, role, text): conv_id, turn, history.

    Copies of a turn count once; different texts of one turn stand in order of role and
    text. A turn is its lines ``role: text`` and counts a token for each word of them and
    one more; turns without text are left out, also as history, and a first turn has none.
    With the running total of tokens, the history is a range frame, and since it
    reaches back no further than ``tokens``, a conversation is cut into blocks of that
    many: a turn meets the turns of its own block and the one before, whatever the
    length of the conversation.
    """
    line = F.concat_ws(": ", "role", "text")
    whole = turns.where("text IS NOT NULL").groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_set(line)).alias("_lines"))
    size = F.size(F.regexp_extract_all(F.array_join("_lines", " "), F.lit(WORD), 0))
    whole = whole.select("conv_id", "turn", F.array_join("_lines", "\n").alias("_text"),
                         (size + 1).cast("long").alias("_size"))
    placed = running_before(whole, ["conv_id"], "turn", "_size", "_c")
    block = F.floor(F.col("_c") / tokens)
    shown = placed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_next")) \
        .withColumn("_block", block + F.col("_next"))
    before = Window.partitionBy("conv_id", "_block").orderBy("_c").rangeBetween(-tokens, -1)
    return shown.withColumn("history", F.array_join(F.collect_list("_text").over(before), "\n")) \
        .where((F.col("_next") == 0) & (F.col("history") != "")).select("conv_id", "turn", "history")


def _by_day(orders: DataFrame, *keys: str) -> DataFrame:
    daily = orders.groupBy(*keys, "date").agg(
        F.sum("quantity").alias("total_sales"), F.sum("revenue").alias("revenue"),
        F.count_distinct("customer_id").alias("customers"),
        *[F.sum(n).alias(n) for n in CATEGORY_COLUMNS])
    return daily.withColumn("inventory_level", stock_level())


def stock_level() -> Column:
    """Derived daily stock: a fixed rule on the day number, 500 to 7999."""
    day = F.datediff(F.col("date"), F.lit(STOCK_EPOCH).cast("date"))
    return (500 + (day * 131) % 7500).cast("bigint")

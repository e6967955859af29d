"""DuckDB SQL for the registered queries, written from the definitions and not from
the Spark code. Queries by random forest, fitted smoothing or fitted regression have
no SQL; tests/ checks those against brute force and by their properties.
"""

from __future__ import annotations

# Building blocks: common table expressions, put together by ``_with``.
BLOCKS = {
    "line": """SELECT l_orderkey AS order_id, l_partkey AS product_id,
        CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS unit_price,
        CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS revenue
      FROM lineitem""",
    "head": """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
        CAST(o_orderdate AS DATE) AS date FROM orders""",
    "buyer": """SELECT c_custkey AS customer_id, r_name AS region
      FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey""",
    "item": """SELECT p_partkey AS product_id, p_name AS product_name,
        p_type AS category, 10 AS reorder_level FROM part""",
    "sale": "SELECT * FROM line JOIN head USING (order_id)",
    "today": "SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders",
    "daily": """SELECT date, count(*) AS sale_rows, count(DISTINCT order_id) AS orders,
        CAST(sum(quantity) AS BIGINT) AS total_sales, sum(revenue) AS revenue,
        CAST(500 + (date_diff('day', DATE '1995-01-01', date) * 131) % 7500 AS BIGINT)
          AS inventory_level
      FROM sale GROUP BY date""",
    "region_day": """SELECT region, date, count(*) AS sale_rows,
        count(DISTINCT order_id) AS orders,
        CAST(sum(quantity) AS BIGINT) AS total_sales, sum(revenue) AS revenue,
        CAST(500 + (date_diff('day', DATE '1995-01-01', date) * 131) % 7500 AS BIGINT)
          AS inventory_level
      FROM sale JOIN buyer USING (customer_id) GROUP BY region, date""",
    "product_day": """SELECT product_id, date, CAST(sum(quantity) AS BIGINT) AS quantity,
        sum(revenue) AS revenue FROM sale GROUP BY product_id, date""",
    "product_total": """SELECT product_id, product_name, category, count(*) AS sale_rows,
        CAST(sum(quantity) AS BIGINT) AS quantity, sum(revenue) AS revenue
      FROM line JOIN item USING (product_id) GROUP BY ALL""",
    "wide": """SELECT date, CAST(sum(quantity) AS BIGINT) AS total_sales,
        sum(revenue) AS revenue, count(DISTINCT customer_id) AS customers,
        CAST(500 + (date_diff('day', DATE '1995-01-01', date) * 131) % 7500 AS BIGINT)
          AS inventory_level,
        CAST(coalesce(sum(quantity) FILTER (category = 'ECONOMY'), 0) AS DOUBLE) AS economy_sales,
        CAST(coalesce(sum(quantity) FILTER (category = 'LARGE'), 0) AS DOUBLE) AS large_sales,
        CAST(coalesce(sum(quantity) FILTER (category = 'MEDIUM'), 0) AS DOUBLE) AS medium_sales,
        CAST(coalesce(sum(quantity) FILTER (category = 'PROMO'), 0) AS DOUBLE) AS promo_sales,
        CAST(coalesce(sum(quantity) FILTER (category = 'SMALL'), 0) AS DOUBLE) AS small_sales,
        CAST(coalesce(sum(quantity) FILTER (category = 'STANDARD'), 0) AS DOUBLE)
          AS standard_sales
      FROM sale JOIN item USING (product_id) GROUP BY date""",
    "region_wide": """SELECT region, date, CAST(sum(quantity) AS BIGINT) AS total_sales,
        sum(revenue) AS revenue, count(DISTINCT customer_id) AS customers,
        CAST(500 + (date_diff('day', DATE '1995-01-01', date) * 131) % 7500 AS BIGINT)
          AS inventory_level,
        row_number() OVER (PARTITION BY region ORDER BY date DESC) AS age,
        count(*) OVER (PARTITION BY region) AS n
      FROM sale JOIN buyer USING (customer_id) GROUP BY region, date""",
    "region_best": """SELECT *, row_number() OVER (PARTITION BY region
          ORDER BY sales DESC, category_order) AS rank
      FROM (SELECT region, date, lower(c.category) || '_sales' AS category,
          CAST(coalesce(sum(quantity) FILTER (item.category = c.category), 0) AS DOUBLE)
            AS sales, c.category_order
        FROM sale JOIN buyer USING (customer_id) JOIN item USING (product_id),
          (VALUES ('ECONOMY', 1), ('LARGE', 2), ('MEDIUM', 3), ('PROMO', 4), ('SMALL', 5),
                  ('STANDARD', 6)) AS c(category, category_order)
        WHERE (region, date) IN (SELECT (region, max(date)) FROM sale
          JOIN buyer USING (customer_id) GROUP BY region)
        GROUP BY region, date, c.category, c.category_order)""",
    "region_state": """SELECT *, (recent_mean - previous_mean) / previous_mean * 100
          AS change_pct, mean_inventory / recent_mean AS days_of_supply FROM (
        SELECT region,
          sum(total_sales) FILTER (age <= 30)::DOUBLE / count(*) FILTER (age <= 30)
            AS recent_mean,
          sum(total_sales) FILTER (age > least(n, 60) - 30 AND age <= least(n, 60))::DOUBLE
            / count(*) FILTER (age > least(n, 60) - 30 AND age <= least(n, 60))
            AS previous_mean,
          sum(inventory_level) FILTER (age <= 30)::DOUBLE / count(*) FILTER (age <= 30)
            AS mean_inventory
        FROM region_wide GROUP BY region)""",
    "long": """SELECT date, category, sales,
        CASE category WHEN 'economy_sales' THEN 1 WHEN 'large_sales' THEN 2
          WHEN 'medium_sales' THEN 3 WHEN 'promo_sales' THEN 4 WHEN 'small_sales' THEN 5
          ELSE 6 END AS category_order,
        upper(category[1]) || lower(replace(category, '_sales', '')[2:]) AS display_name
      FROM (UNPIVOT (SELECT date, economy_sales, large_sales, medium_sales, promo_sales,
                            small_sales, standard_sales FROM wide)
            ON COLUMNS(* EXCLUDE date) INTO NAME category VALUE sales)""",
    "stock": """SELECT product_id, last_updated,
        max(quantity_on_hand) AS quantity_on_hand FROM (
          SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS last_updated,
            10 + (l_orderkey * 37 + l_linenumber) % 190 AS quantity_on_hand,
            max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_partkey) AS newest
          FROM lineitem) WHERE last_updated = newest GROUP BY 1, 2""",
    "demand": """SELECT product_id, CAST(sum(quantity) AS BIGINT) AS recent_quantity,
        sum(quantity)::DOUBLE / 30 AS daily_demand
      FROM sale, today WHERE date > d - 30 AND date <= d GROUP BY product_id""",
    "position": """SELECT item.*, coalesce(quantity_on_hand, 0) AS quantity_on_hand,
        coalesce(recent_quantity, 0) AS recent_quantity,
        coalesce(daily_demand, 0.0::DOUBLE) AS daily_demand
      FROM item LEFT JOIN stock USING (product_id) LEFT JOIN demand USING (product_id)""",
    "status": """SELECT *, CASE WHEN daily_demand = 0 THEN 'no_demand'
          WHEN days_of_stock < 15 THEN 'critical' WHEN days_of_stock < 20 THEN 'low'
          WHEN days_of_stock <= 90 THEN 'healthy' ELSE 'overstock' END AS risk,
        quantity_on_hand < reorder_level AS below_reorder,
        CAST(greatest(0, ceil(daily_demand * 44 - quantity_on_hand)) AS BIGINT)
          AS restock_quantity
      FROM (SELECT *, CASE WHEN daily_demand > 0
              THEN quantity_on_hand::DOUBLE / daily_demand ELSE 999 END AS days_of_stock
            FROM position)""",
    "urgent": """SELECT *, CASE WHEN days_of_stock < 15 THEN 'critical'
          WHEN days_of_stock < 20 THEN 'low' ELSE 'reorder' END AS urgency
      FROM status WHERE restock_quantity > 0 AND (days_of_stock < 20 OR below_reorder)""",
    "rfm": """SELECT customer_id, CAST(date_diff('day', max(date), any_value(d)) AS INTEGER)
          AS recency, count(DISTINCT order_id) AS frequency,
        sum(revenue)::DOUBLE AS monetary
      FROM sale, today GROUP BY customer_id""",
    "cut": """SELECT quantile_cont(recency, 1.0/3) AS r1, quantile_cont(recency, 2.0/3) AS r2,
        quantile_cont(frequency, 1.0/3) AS f1, quantile_cont(frequency, 2.0/3) AS f2,
        quantile_cont(monetary, 1.0/3) AS m1, quantile_cont(monetary, 2.0/3) AS m2,
        quantile_cont(monetary, 0.8) AS m_top FROM rfm""",
    "segment": """SELECT *, CASE WHEN rfm_score <= 4 THEN 'At-Risk'
          WHEN rfm_score <= 6 THEN 'Loyal' ELSE 'Champions' END AS segment
      FROM (SELECT *, r_score + f_score + m_score AS rfm_score FROM (
        SELECT rfm.*, m_top,
          CASE WHEN recency <= r1 THEN 3 WHEN recency <= r2 THEN 2 ELSE 1 END AS r_score,
          CASE WHEN frequency <= f1 THEN 1 WHEN frequency <= f2 THEN 2 ELSE 3 END AS f_score,
          CASE WHEN monetary <= m1 THEN 1 WHEN monetary <= m2 THEN 2 ELSE 3 END AS m_score
        FROM rfm, cut))""",
    "retention": """SELECT customer_id, segment, recency, frequency, monetary,
        monetary >= m_top AS is_top_customer,
        CASE segment WHEN 'At-Risk' THEN 'win_back_offer' WHEN 'Loyal' THEN 'loyalty_points'
          ELSE 'early_access' END AS action,
        CASE WHEN monetary >= m_top AND segment <> 'Champions' THEN 'high'
          WHEN segment = 'At-Risk' THEN 'medium' ELSE 'low' END AS priority
      FROM segment""",
    "price": """SELECT item.product_id, item.product_name, item.category,
        coalesce(quantity, 0) AS units, revenue::DOUBLE / quantity::DOUBLE AS unit_revenue
      FROM item LEFT JOIN product_total USING (product_id)""",
    "pricing": """SELECT price.*, CASE WHEN units <= slow THEN -10 ELSE 5 END
          AS price_change_pct,
        CASE WHEN units <= slow THEN 'slow_mover' ELSE 'high_margin' END AS reason,
        CASE WHEN units <= slow THEN unit_revenue * (1 + -10 / 100.0)
          ELSE unit_revenue * (1 + 5 / 100.0) END AS suggested_price
      FROM price, (SELECT quantile_cont(unit_revenue, 0.8) AS high,
                          quantile_cont(units, 0.2) AS slow FROM price)
      WHERE units <= slow OR unit_revenue >= high""",
    "total": """SELECT sum(revenue) AS total, CAST(sum(quantity) AS BIGINT) AS quantity,
        count(*) AS sale_rows,
        coalesce(sum(revenue) FILTER (date >= d - 30 AND date <= d), 0) AS recent,
        coalesce(sum(revenue) FILTER (date >= d - 60 AND date < d - 30), 0) AS previous
      FROM sale, today""",
    "daily_z": """SELECT *, (revenue::DOUBLE - expected) / std AS z_score FROM (
        SELECT *, sum(revenue) OVER ()::DOUBLE / count(*) OVER () AS expected,
          nullif(stddev_pop(revenue::DOUBLE) OVER (), 0) AS std FROM daily)""",
    "product_z": """SELECT *, (revenue::DOUBLE - expected) / std AS z_score FROM (
        SELECT *, sum(revenue) OVER w::DOUBLE / count(*) OVER w AS expected,
          nullif(stddev_pop(revenue::DOUBLE) OVER w, 0) AS std
        FROM product_day WINDOW w AS (PARTITION BY product_id))""",
    "wide_rank": """SELECT *, row_number() OVER (ORDER BY date DESC) AS age FROM wide""",
    "state": """SELECT *, (recent_mean - previous_mean) / previous_mean * 100 AS change_pct,
        mean_inventory / recent_mean AS days_of_supply FROM (
        SELECT sum(total_sales) FILTER (age <= 30)::DOUBLE / 30 AS recent_mean,
          sum(total_sales) FILTER (age > 30 AND age <= 60)::DOUBLE / 30 AS previous_mean,
          sum(inventory_level) FILTER (age <= 30)::DOUBLE / 30 AS mean_inventory,
          sum(revenue) FILTER (age <= 30)::DOUBLE / 30 AS mean_revenue,
          stddev_pop(total_sales) FILTER (age <= 30) AS std_sales
        FROM wide_rank)""",
    "best": """SELECT *, row_number() OVER (ORDER BY sales DESC, category_order) AS rank
      FROM long WHERE date = (SELECT max(date) FROM long)""",
    "spoken": """SELECT conv_id, turn, string_agg(DISTINCT role || ': ' || text, chr(10)
          ORDER BY role || ': ' || text) AS lines
        FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn""",
    "counted": r"""SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) - size AS c
        FROM (SELECT *, len(regexp_extract_all(lines, '[^\x20\x09-\x0D]+')) + 1 AS size
          FROM spoken)""",
    "told": """SELECT conv_id, turn, string_agg(lines, chr(10)) OVER (PARTITION BY conv_id
          ORDER BY c RANGE BETWEEN 500 PRECEDING AND 1 PRECEDING) AS history FROM counted""",
    "asked": """SELECT 'turn-' || a.conv_id || '-' || a.turn AS question_id,
        told.history, a.text AS question
      FROM conversations a LEFT JOIN told USING (conv_id, turn) WHERE a.role = 'user'""",
    "intent": """SELECT *, CASE
          WHEN contains(lower(question), 'drop') OR contains(lower(question), 'decrease')
            OR contains(lower(question), 'why') THEN 'drop'
          WHEN contains(lower(question), 'forecast') OR contains(lower(question), 'predict')
            OR contains(lower(question), 'future') THEN 'forecast'
          WHEN contains(lower(question), 'inventory') THEN 'inventory'
          WHEN contains(lower(question), 'recommend') THEN 'recommend'
          ELSE 'general' END AS intent
      FROM asked""",
    "event_day": """SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n_rows,
        sum(CAST(value AS DECIMAL(18,4))) AS total FROM events GROUP BY 1, 2""",
}

NEEDS = {
    "counted": ["spoken"], "told": ["counted"], "asked": ["told"], "intent": ["asked"],
    "sale": ["line", "head"], "daily": ["sale"], "region_day": ["sale", "buyer"],
    "product_day": ["sale"], "product_total": ["line", "item"], "wide": ["sale", "item"],
    "long": ["wide"], "demand": ["sale", "today"], "position": ["item", "stock", "demand"],
    "status": ["position"], "urgent": ["status"], "rfm": ["sale", "today"], "cut": ["rfm"],
    "segment": ["rfm", "cut"], "retention": ["segment"], "price": ["product_total"],
    "pricing": ["price"], "total": ["sale", "today"], "daily_z": ["daily"],
    "product_z": ["product_day"], "wide_rank": ["wide"], "state": ["wide_rank"],
    "best": ["long"], "region_wide": ["sale", "buyer"],
    "region_best": ["sale", "buyer", "item"], "region_state": ["region_wide"],
}


def _with(names: str, select: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    blocks = ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in ordered)
    return f"WITH {blocks}\n{select}"


def _period(value: str, source: str, key: str = "", short: str = "overlap",
            extra: str = "") -> str:
    """Mean of the last 30 rows against the 30 before, by row position."""
    part = f"PARTITION BY {key}" if key else ""
    lead = f"{key}," if key else ""
    if short == "overlap":
        side = "age > least(n, 60) - 30 AND age <= least(n, 60)"
    else:
        side = "(n > 60 AND age BETWEEN 31 AND 60) OR (n <= 60 AND age <= 30)"
    return f"""SELECT *, coalesce((recent_mean - previous_mean)
        / nullif(previous_mean, 0) * 100, 0) AS change_pct FROM (
      SELECT {lead}
        sum({value}) FILTER (age <= 30)::DOUBLE / count(*) FILTER (age <= 30) AS recent_mean,
        sum({value}) FILTER ({side})::DOUBLE / count(*) FILTER ({side}) AS previous_mean,
        sum(revenue) FILTER (age <= 30)::DOUBLE / count(*) FILTER (age <= 30) AS mean_revenue
      FROM (SELECT *, row_number() OVER ({part} ORDER BY date DESC) AS age,
              count(*) OVER ({part}) AS n FROM {source}) {'GROUP BY ' + key if key else ''})"""


PERIOD_COLUMNS = """round(recent_mean, 4) AS recent_mean,
  round(previous_mean, 4) AS previous_mean, round(change_pct, 4) AS change_pct"""
BREAKDOWN = """CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue,
  CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS sale_rows,
  round(sum(revenue)::DOUBLE * 0.6, 4) AS cost,
  round(sum(revenue)::DOUBLE - sum(revenue)::DOUBLE * 0.6, 4) AS profit,
  round((sum(revenue)::DOUBLE - sum(revenue)::DOUBLE * 0.6)
        / sum(revenue)::DOUBLE * 100, 4) AS profit_margin"""


def _forecast(source: str, key: str = "", window: int = 30) -> str:
    """Flat mean of the last rows for 30 days, with 1.96 population deviations."""
    part = f"PARTITION BY {key}" if key else ""
    lead = f"{key}," if key else ""
    return f"""SELECT {lead} CAST(last + CAST(i AS INTEGER) AS DATE) AS ds, level AS yhat,
        level - std * 1.96 AS lower, level + std * 1.96 AS upper
      FROM (SELECT {lead} max(date) AS last,
              sum(total_sales)::DOUBLE / count(*) AS level,
              stddev_pop(total_sales) AS std
            FROM (SELECT *, row_number() OVER ({part} ORDER BY date DESC) AS age
                  FROM {source}) WHERE age <= {window} {'GROUP BY ' + key if key else ''}),
        range(1, 31) AS r(i)"""


def _delta(source: str, key: str = "") -> str:
    part = f"PARTITION BY {key}" if key else ""
    lead = f"{key}," if key else ""
    join = f"JOIN actual USING ({key})" if key else ", actual"
    group = f"GROUP BY {key}" if key else ""
    return _with(source, f"""
      , fc AS ({_forecast(source, key, 90)}),
      actual AS (SELECT {lead} sum(total_sales)::DOUBLE / count(*) AS actual_mean
        FROM (SELECT *, row_number() OVER ({part} ORDER BY date DESC) AS age FROM {source})
        WHERE age <= 30 {group}),
      ahead AS (SELECT {lead} avg(yhat) AS forecast_mean, avg(lower) AS lower_mean,
          avg(upper) AS upper_mean FROM fc {group})
      SELECT {lead} round(forecast_mean, 4) AS forecast_mean,
        round(lower_mean, 4) AS lower_mean, round(upper_mean, 4) AS upper_mean,
        round(actual_mean, 4) AS actual_mean,
        round(forecast_mean - actual_mean, 4) AS delta
      FROM ahead {join}""")


ORACLES: dict[str, str] = {}

# -- sources and projections ---------------------------------------------------------

ORACLES["sales_fact"] = _with("sale buyer item", """
SELECT date, order_id, product_id, product_name, category, customer_id, region, quantity,
  unit_price, revenue::DOUBLE AS revenue
FROM sale JOIN buyer USING (customer_id) JOIN item USING (product_id)""")

ORACLES["unmatched_lines"] = _with("line head item buyer", """
SELECT CASE WHEN head.order_id IS NULL THEN 'order' WHEN item.product_id IS NULL THEN 'product'
    WHEN buyer.customer_id IS NULL THEN 'region' ELSE 'none' END AS missing,
  count(*) AS sale_rows, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue
FROM line LEFT JOIN head USING (order_id) LEFT JOIN item USING (product_id)
LEFT JOIN buyer USING (customer_id) GROUP BY 1""")

ORACLES["validate_sales"] = _with("sale buyer item", """
SELECT concat_ws(',', CASE WHEN quantity > 45 THEN 'quantity_above_limit' END,
    CASE WHEN date < DATE '1996-01-01' THEN 'date_before_start' END) AS failed,
  count(*) AS n_rows, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue
FROM sale JOIN buyer USING (customer_id) JOIN item USING (product_id) GROUP BY 1""")

ORACLES["loaded_sales"] = _with("sale buyer item", """
, fact AS (SELECT *, order_id * 7 + product_id AS n, order_id % 2 AS k
  FROM sale JOIN buyer USING (customer_id) JOIN item USING (product_id)),
texts AS (SELECT *, CASE WHEN n % 11 = 0 THEN '"' || product_name || ' ""new' || chr(10)
      || 'line"", ' || (n % 5) || '"' ELSE product_name END AS p,
    CASE WHEN n % 13 = 0 THEN 'x' ELSE '' END || quantity AS q, revenue::VARCHAR AS r,
    customer_id::VARCHAR AS c, date::VARCHAR AS d FROM fact),
written AS (SELECT *, CASE
    WHEN n % 17 = 0 AND k = 0 THEN concat_ws(',', p, q, r, c, region)
    WHEN n % 17 = 0 THEN concat_ws(',', d, region, c, p, r)
    WHEN k = 0 THEN concat_ws(',', p, q, r, c, region, d)
    ELSE concat_ws(',', d, region, c, p, r, q) END
      || CASE WHEN n % 19 = 0 AND n % 17 <> 0 THEN ',extra' ELSE '' END AS raw,
    CASE WHEN n % 13 <> 0 AND NOT (n % 17 = 0 AND k = 1) THEN quantity END AS amount,
    CASE WHEN NOT (n % 17 = 0 AND k = 0) THEN date END AS day FROM texts),
checked AS (SELECT *, concat_ws(',',
    CASE WHEN n % 17 = 0 OR n % 19 = 0 THEN 'record_malformed' END,
    CASE WHEN amount IS NULL THEN 'quantity_invalid' END,
    CASE WHEN day IS NULL THEN 'date_invalid' END) AS failed FROM written)
SELECT CASE WHEN n % 11 = 0 THEN product_name || ' "new' || chr(10) || 'line", ' || (n % 5)
    ELSE product_name END AS product_name, CAST(amount AS INTEGER) AS quantity,
  revenue::DOUBLE AS revenue, customer_id::VARCHAR AS customer_id, region, day AS date, failed,
  CASE WHEN failed <> '' THEN raw END AS raw
FROM checked""")

ORACLES["loaded_stock"] = """
WITH counts AS (SELECT p_name AS name,
    CAST(10 + (l_orderkey * 37 + l_linenumber) % 190 AS INTEGER) AS q, CAST(l_shipdate AS DATE) AS d
  FROM lineitem JOIN part ON l_partkey = p_partkey),
newest AS (SELECT name, max({'d': d, 'q': q}) AS s FROM counts WHERE q % 23 <> 0 GROUP BY name)
SELECT p_partkey AS product_id, s.q AS quantity_on_hand, s.d AS last_updated
FROM part JOIN newest ON p_name = name"""

ORACLES["latest_inventory"] = _with("stock", """
SELECT product_id, CAST(quantity_on_hand AS INTEGER) AS quantity_on_hand, last_updated
FROM stock""")

ORACLES["profit_lines"] = _with("line", """
SELECT order_id, product_id, quantity, unit_price, revenue::DOUBLE AS revenue,
  round(revenue::DOUBLE * 0.6, 4) AS cost,
  round(revenue::DOUBLE - revenue::DOUBLE * 0.6, 4) AS profit,
  round((revenue::DOUBLE - revenue::DOUBLE * 0.6) / revenue::DOUBLE * 100, 4)
    AS profit_margin
FROM line""")

ORACLES["trailing_daily"] = _with("daily", """
SELECT date, total_sales, CAST(round(revenue, 2) AS DOUBLE) AS revenue, inventory_level
FROM daily ORDER BY date DESC LIMIT 30""")

ORACLES["category_long"] = _with("long", "SELECT * FROM long")

ORACLES["daily_wide"] = _with("wide", """
SELECT date, economy_sales, large_sales, medium_sales, promo_sales, small_sales,
  standard_sales FROM wide""")

# -- totals and rankings ---------------------------------------------------------------

ORACLES["kpi_summary"] = _with("total product_total", """
SELECT CAST(round(total, 2) AS DOUBLE) AS total_revenue,
  quantity AS total_sales_quantity, round(total::DOUBLE / sale_rows, 2) AS avg_order_value,
  (SELECT product_name FROM product_total ORDER BY revenue DESC, product_id LIMIT 1)
    AS top_product,
  round(CASE WHEN previous > 0 THEN (recent::DOUBLE - previous::DOUBLE)
    / previous::DOUBLE * 100 ELSE 0 END, 2) AS revenue_growth_pct
FROM total""")

ORACLES["business_context"] = _with("total product_total", """
SELECT CAST(round(total, 2) AS DOUBLE) AS total_revenue,
  sale_rows AS total_sales_orders, CAST(round(recent, 2) AS DOUBLE) AS recent_revenue,
  CAST(round(previous, 2) AS DOUBLE) AS previous_revenue,
  round(CASE WHEN previous > 0 THEN (recent::DOUBLE - previous::DOUBLE)
    / previous::DOUBLE * 100 ELSE 0 END, 4) AS revenue_change_pct,
  round(recent::DOUBLE / greatest(total, 1)::DOUBLE * 100, 4) AS recent_share_pct,
  CAST(rank AS INTEGER) AS rank, product_id, name, revenue
FROM total, (SELECT product_id, product_name AS name,
    CAST(round(revenue, 2) AS DOUBLE) AS revenue,
    row_number() OVER (ORDER BY product_total.revenue DESC, product_id) AS rank
  FROM product_total) WHERE rank <= 5""")

ORACLES["sales_trend"] = _with("sale today", """
SELECT date, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue,
  CAST(sum(quantity) AS BIGINT) AS quantity
FROM sale, today WHERE date >= d - 90 GROUP BY date""")

ORACLES["stored_sales_trend"] = ORACLES["sales_trend"]

ORACLES["monthly_revenue"] = _with("sale", f"""
SELECT CAST(date_trunc('month', date) AS DATE) AS month, {BREAKDOWN}
FROM sale GROUP BY 1""")

ORACLES["revenue_by_region"] = _with("sale buyer", f"""
SELECT region, {BREAKDOWN},
  round(sum(revenue)::DOUBLE / (SELECT sum(revenue) FROM sale)::DOUBLE * 100, 4)
    AS share_pct
FROM sale JOIN buyer USING (customer_id) GROUP BY region""")

ORACLES["revenue_by_category"] = _with("line item", f"""
SELECT category, {BREAKDOWN},
  round(sum(revenue)::DOUBLE / (SELECT sum(revenue) FROM line)::DOUBLE * 100, 4)
    AS share_pct
FROM line JOIN item USING (product_id) GROUP BY category""")

ORACLES["top_products"] = _with("product_total", """
SELECT product_id, product_name, category, sale_rows, quantity,
  CAST(round(product_total.revenue, 2) AS DOUBLE) AS revenue
FROM product_total ORDER BY product_total.revenue DESC, product_id LIMIT 10""")

ORACLES["dataset_stats"] = _with("sale", """
SELECT count(*) AS sale_rows, min(date) AS first_date, max(date) AS last_date,
  count(DISTINCT product_id) AS products, count(DISTINCT customer_id) AS customers
FROM sale""")

ORACLES["kpi_cards"] = _with("wide_rank", """
SELECT max(date) AS as_of, max(total_sales) FILTER (age = 1) AS latest_sales,
  round((max(total_sales) FILTER (age = 1) - max(total_sales) FILTER (age = 2))::DOUBLE
    / max(total_sales) FILTER (age = 2) * 100, 4) AS sales_day_change_pct,
  max(inventory_level) FILTER (age = 1) AS latest_inventory,
  round((max(inventory_level) FILTER (age = 1) - max(inventory_level) FILTER (age = 2))
    ::DOUBLE / max(inventory_level) FILTER (age = 2) * 100, 4) AS inventory_day_change_pct,
  CAST(round(sum(revenue) FILTER (age <= 30), 2) AS DOUBLE) AS revenue_recent,
  round(sum(customers) FILTER (age <= 7)::DOUBLE / 7, 4) AS mean_customers
FROM wide_rank""")

ORACLES["kpi_cards_by_region"] = _with("region_wide", """
SELECT region, max(date) AS as_of, max(total_sales) FILTER (age = 1) AS latest_sales,
  round((max(total_sales) FILTER (age = 1) - max(total_sales) FILTER (age = 2))::DOUBLE
    / max(total_sales) FILTER (age = 2) * 100, 4) AS sales_day_change_pct,
  max(inventory_level) FILTER (age = 1) AS latest_inventory,
  round((max(inventory_level) FILTER (age = 1) - max(inventory_level) FILTER (age = 2))
    ::DOUBLE / max(inventory_level) FILTER (age = 2) * 100, 4) AS inventory_day_change_pct,
  CAST(round(sum(revenue) FILTER (age <= 30), 2) AS DOUBLE) AS revenue_recent,
  round(sum(customers) FILTER (age <= 7)::DOUBLE / count(*) FILTER (age <= 7), 4)
    AS mean_customers
FROM region_wide GROUP BY region""")

# -- series -------------------------------------------------------------------------------

ORACLES["period_over_period"] = _with("daily", f"""
SELECT {PERIOD_COLUMNS} FROM ({_period("total_sales", "daily")})""")

ORACLES["period_over_period_by_region"] = _with("region_day", f"""
SELECT region, {PERIOD_COLUMNS} FROM ({_period("revenue", "region_day", "region")})""")

ORACLES["period_over_period_short"] = _with("product_day", f"""
SELECT product_id, {PERIOD_COLUMNS}, 'overlap' AS rule
FROM ({_period("quantity", "product_day", "product_id")})
UNION ALL
SELECT product_id, {PERIOD_COLUMNS}, 'same' AS rule
FROM ({_period("quantity", "product_day", "product_id", "same")})""")

ORACLES["sales_drop"] = _with("daily", f"""
SELECT {PERIOD_COLUMNS}, p.change_pct < -15 AS is_drop,
  round(abs(p.change_pct / 100) * mean_revenue, 4) AS lost_revenue
FROM ({_period("total_sales", "daily")}) p""")

ORACLES["sales_drop_by_region"] = _with("region_day", f"""
SELECT region, {PERIOD_COLUMNS}, p.change_pct < -2 AS is_drop,
  round(abs(p.change_pct / 100) * mean_revenue, 4) AS lost_revenue
FROM ({_period("total_sales", "region_day", "region")}) p""")

ORACLES["day_over_day"] = _with("daily", """
SELECT date, total_sales, round((total_sales - lag(total_sales) OVER w)::DOUBLE
  / lag(total_sales) OVER w * 100, 4) AS change_pct
FROM daily WINDOW w AS (ORDER BY date)""")

ORACLES["day_over_day_by_region"] = _with("region_day", """
SELECT region, date, total_sales, round((total_sales - lag(total_sales) OVER w)::DOUBLE
  / lag(total_sales) OVER w * 100, 4) AS change_pct
FROM region_day WINDOW w AS (PARTITION BY region ORDER BY date)""")

ORACLES["moving_average_7"] = _with("daily", """
SELECT date, total_sales, round(sum(total_sales) OVER w::DOUBLE / count(*) OVER w, 4)
  AS moving_average
FROM daily WINDOW w AS (ORDER BY date ROWS 6 PRECEDING)""")

ORACLES["moving_average_7_by_region"] = _with("region_day", """
SELECT region, date, total_sales,
  round(sum(total_sales) OVER w::DOUBLE / count(*) OVER w, 4) AS moving_average
FROM region_day WINDOW w AS (PARTITION BY region ORDER BY date ROWS 6 PRECEDING)""")

ORACLES["category_means"] = _with("long", """
SELECT category, display_name, category_order,
  round(sum(sales) / count(*), 4) AS mean_sales
FROM long WHERE date IN (SELECT DISTINCT date FROM long ORDER BY date DESC LIMIT 7)
GROUP BY ALL""")

ORACLES["top_categories"] = _with("best", """
SELECT date, CAST(rank AS INTEGER) AS rank, category, display_name, sales
FROM best WHERE rank <= 3""")

ORACLES["top_categories_by_region"] = _with("region_best", """
SELECT region, date, CAST(rank AS INTEGER) AS rank, category, sales
FROM region_best WHERE rank <= 2""")

for _name, _source, _key in (("", "daily", ""), ("_by_region", "region_day", "region")):
    _lead, _group = (f"{_key},", f"GROUP BY {_key}") if _key else ("", "")
    _part = f"PARTITION BY {_key}" if _key else ""
    ORACLES[f"metric_correlation{_name}"] = _with(_source, f"""
SELECT {_lead} count(*) AS n_days,
  round(CASE WHEN stddev_pop(total_sales) * stddev_pop(inventory_level) > 0
    THEN covar_pop(total_sales, inventory_level)
      / (stddev_pop(total_sales) * stddev_pop(inventory_level)) END, 6) AS correlation
FROM {_source} {_group}""")
    ORACLES[f"inventory_health{_name}"] = _with(_source, f"""
SELECT {_lead} round(inv, 4) AS mean_inventory, round(sold, 4) AS mean_sales,
  round(CASE WHEN sold > 0 THEN inv / sold ELSE 999 END, 4) AS days_of_supply,
  CASE WHEN sold > 0 THEN inv / sold ELSE 999 END < 20 AS alert
FROM (SELECT {_lead} sum(inventory_level)::DOUBLE / count(*) AS inv,
        sum(total_sales)::DOUBLE / count(*) AS sold
      FROM (SELECT *, row_number() OVER ({_part} ORDER BY date DESC) AS age FROM {_source})
      WHERE age <= 30 {_group})""")
    ORACLES[f"moving_average_forecast{_name}"] = _with(_source, f"""
SELECT {_lead} ds, round(yhat, 4) AS yhat, round(lower, 4) AS lower,
  round(upper, 4) AS upper FROM ({_forecast(_source, _key)})""")
    ORACLES[f"forecast_delta{_name}"] = _delta(_source, _key)

# -- customers ------------------------------------------------------------------------------

ORACLES["rfm_segments"] = _with("segment", "SELECT * EXCLUDE (m_top) FROM segment")

ORACLES["rfm_summary"] = _with("segment", """
SELECT segment, count(*) AS customers,
  CAST(round(sum(CAST(monetary AS DECIMAL(28,4))), 2) AS DOUBLE) AS revenue,
  round(sum(recency)::DOUBLE / count(*), 4) AS mean_recency
FROM segment GROUP BY segment""")

ORACLES["retention_actions"] = _with("retention", "SELECT * FROM retention")

# -- stock ------------------------------------------------------------------------------------

ORACLES["inventory_status"] = _with("status", """
SELECT product_id, product_name, category, quantity_on_hand, recent_quantity,
  round(daily_demand, 4) AS daily_demand, round(days_of_stock, 4) AS days_of_stock, risk,
  below_reorder FROM status""")

ORACLES["inventory_needs"] = _with("status", """
SELECT product_id, quantity_on_hand, round(daily_demand * 30, 4) AS expected_demand,
  restock_quantity FROM status""")

ORACLES["restock_list"] = _with("urgent", """
SELECT product_id, product_name, quantity_on_hand, round(days_of_stock, 4) AS days_of_stock,
  urgency, restock_quantity FROM urgent""")

ORACLES["inventory_anomalies"] = _with("status", """
, stats AS (SELECT avg(days_of_stock) AS mean, stddev_pop(days_of_stock) AS std
  FROM status WHERE daily_demand > 0),
scored AS (SELECT *, (days_of_stock - mean) / nullif(std, 0) AS z_score FROM status, stats
  WHERE daily_demand > 0),
flagged AS (SELECT *, CASE WHEN z_score > 3 THEN 'excess_stock'
    WHEN z_score < -3 THEN 'low_stock' WHEN risk = 'critical' THEN 'stock_out_risk' END
    AS anomaly_type FROM scored)
SELECT product_id, product_name, round(days_of_stock, 4) AS days_of_stock, risk,
  round(z_score, 4) AS z_score, anomaly_type
FROM flagged WHERE anomaly_type IS NOT NULL""")

ORACLES["pricing_suggestions"] = _with("pricing", """
SELECT product_id, product_name, category, units, round(unit_revenue, 4) AS unit_revenue,
  price_change_pct, reason, round(suggested_price, 4) AS suggested_price FROM pricing""")

# -- outliers -----------------------------------------------------------------------------------

ORACLES["zscore_daily"] = _with("daily_z", """
SELECT date, expected AS expected_sales,
  revenue::DOUBLE AS actual_sales, round(z_score, 4) AS z_score,
  CASE WHEN abs(daily_z.z_score) >= 5 THEN 'critical'
    WHEN abs(daily_z.z_score) >= 4 THEN 'high' ELSE 'medium' END AS severity
FROM daily_z WHERE abs(daily_z.z_score) > 2""")

ORACLES["zscore_products"] = _with("product_z item", """
SELECT date, product_id, product_name, expected AS expected_sales,
  revenue::DOUBLE AS actual_sales, round(z_score, 4) AS z_score,
  CASE WHEN abs(product_z.z_score) >= 5 THEN 'critical'
    WHEN abs(product_z.z_score) >= 4 THEN 'high' ELSE 'medium' END AS severity
FROM product_z JOIN item USING (product_id) WHERE abs(product_z.z_score) > 3""")

ORACLES["recent_anomalies"] = _with("daily_z", """
SELECT date, CAST(round(revenue, 2) AS DOUBLE) AS revenue, expected,
  round(z_score, 4) AS z_score
FROM (SELECT * FROM daily_z ORDER BY date DESC LIMIT 90) d WHERE abs(d.z_score) > 1.5""")

ORACLES["unified_alerts"] = _with("daily_z product_z status", """
SELECT 'revenue' AS alert, date, CAST(NULL AS BIGINT) AS product_id,
  expected AS expected_sales, revenue::DOUBLE AS actual_sales,
  CASE WHEN abs(z_score) >= 5 THEN 'critical' WHEN abs(z_score) >= 4 THEN 'high'
    ELSE 'medium' END AS severity, CAST(NULL AS DOUBLE) AS days_of_stock
FROM daily_z WHERE abs(z_score) > 2
UNION ALL
SELECT 'product', date, product_id, expected, revenue::DOUBLE,
  CASE WHEN abs(z_score) >= 5 THEN 'critical' WHEN abs(z_score) >= 4 THEN 'high'
    ELSE 'medium' END, NULL
FROM product_z WHERE abs(z_score) > 3
UNION ALL
SELECT 'inventory', NULL, product_id, NULL, NULL, 'critical', round(days_of_stock, 4)
FROM status WHERE risk = 'critical'""")

ORACLES["revenue_features"] = _with("daily", """
SELECT date, revenue::DOUBLE AS daily_revenue, orders::DOUBLE AS order_count,
  sum(daily.revenue) OVER week::DOUBLE / count(*) OVER week AS moving_average,
  round(coalesce((daily.revenue::DOUBLE - lag(daily.revenue) OVER w::DOUBLE)
    / lag(daily.revenue) OVER w::DOUBLE * 100, 0), 4) AS change_pct
FROM daily WINDOW w AS (ORDER BY date), week AS (ORDER BY date ROWS 6 PRECEDING)""")

# -- forecasts --------------------------------------------------------------------------------------

ORACLES["demand_forecast"] = _with("product_day today", """
, level AS (SELECT product_id,
    coalesce(sum(quantity) FILTER (date > d - 30 AND date <= d), 0)::DOUBLE / 30 AS mean,
    coalesce(sum(quantity * quantity) FILTER (date > d - 30 AND date <= d), 0)::DOUBLE / 30
      AS squares, any_value(d) AS d FROM product_day, today GROUP BY product_id)
SELECT product_id, CAST(d + CAST(i AS INTEGER) AS DATE) AS ds, round(mean, 4) AS yhat,
  round(mean - sqrt(greatest(squares - mean * mean, 0)) * 1.96, 4) AS lower,
  round(mean + sqrt(greatest(squares - mean * mean, 0)) * 1.96, 4) AS upper
FROM level, range(1, 31) AS r(i)""")

ORACLES["filled_days"] = _with("region_day", """
, span AS (SELECT region, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))
    ::DATE AS ds FROM region_day GROUP BY region)
SELECT span.region, ds, coalesce(total_sales, 0)::DOUBLE AS y
FROM span LEFT JOIN region_day ON span.region = region_day.region AND ds = date""")

# -- advice -------------------------------------------------------------------------------------------

_ADVICE = """SELECT 'restock' AS type, 'Restock soon' AS title,
  'Stock covers ' || CAST(days_of_supply AS DECIMAL(38,1)) || ' days of sales' AS description,
  'high' AS impact, 'Order the fastest sellers; Confirm supplier lead times' AS action_items
FROM state WHERE days_of_supply < 20
UNION ALL
SELECT 'inventory', 'Release tied-up stock',
  'Stock covers ' || CAST(days_of_supply AS DECIMAL(38,1)) || ' days of sales',
  'medium', 'Pause reorders; Clear slow items' FROM state WHERE days_of_supply > 90
UNION ALL
SELECT 'promotion', 'Win back sales',
  'Sales changed by ' || CAST(change_pct AS DECIMAL(38,1)) || ' percent', 'high',
  'Plan a promotion; Check supply of key items' FROM state WHERE change_pct < -15
UNION ALL
SELECT 'category', 'Back ' || display_name,
  display_name || ' sold ' || CAST(sales AS DECIMAL(38,0)) || ' on the newest day', 'medium',
  'Keep it in stock; Feature it in marketing' FROM best WHERE rank <= 2"""

ORACLES["recommendations"] = _with("state best", _ADVICE)

_NAME = "upper(category[1]) || lower(replace(category, '_sales', '')[2:])"
ORACLES["recommendations_by_region"] = _with("region_state region_best", f"""
SELECT region, 'restock' AS type, 'Restock soon' AS title,
  'Stock covers ' || CAST(days_of_supply AS DECIMAL(38,1)) || ' days of sales' AS description,
  'high' AS impact, 'Order the fastest sellers; Confirm supplier lead times' AS action_items
FROM region_state WHERE days_of_supply < 20
UNION ALL
SELECT region, 'inventory', 'Release tied-up stock',
  'Stock covers ' || CAST(days_of_supply AS DECIMAL(38,1)) || ' days of sales',
  'medium', 'Pause reorders; Clear slow items' FROM region_state WHERE days_of_supply > 90
UNION ALL
SELECT region, 'promotion', 'Win back sales',
  'Sales changed by ' || CAST(change_pct AS DECIMAL(38,1)) || ' percent', 'high',
  'Plan a promotion; Check supply of key items' FROM region_state WHERE change_pct < -15
UNION ALL
SELECT region, 'category', 'Back ' || {_NAME},
  {_NAME} || ' sold ' || CAST(sales AS DECIMAL(38,0)) || ' on the newest day', 'medium',
  'Keep it in stock; Feature it in marketing' FROM region_best WHERE rank <= 2""")

ORACLES["action_plan"] = _with("state best", """
SELECT 1 AS step, 'stock' AS topic,
  CASE WHEN days_of_supply < 20 THEN 'urgent_restock' ELSE 'hold' END AS decision,
  CASE WHEN days_of_supply < 20 THEN display_name END AS target,
  round(days_of_supply, 4) AS measure FROM state, best WHERE rank = 1
UNION ALL
SELECT 2, 'sales', CASE WHEN change_pct < -15 THEN 'recovery' ELSE 'growth' END, NULL,
  round(change_pct, 4) FROM state
UNION ALL
SELECT 3, 'focus', 'promote_best', display_name, round(sales, 4) FROM best WHERE rank = 1""")

ORACLES["all_recommendations"] = _with("state best urgent pricing retention", f"""
{_ADVICE}
UNION ALL
SELECT 'restock', 'Reorder ' || product_name,
  'Product ' || product_id || ': order ' || restock_quantity || ' units', 'high',
  'Place the order; Watch daily demand' FROM urgent
UNION ALL
SELECT 'pricing', 'Reprice ' || product_name,
  'Product ' || product_id || ': change by ' || price_change_pct || ' percent', 'medium',
  'Test the new price; Review units sold' FROM pricing
UNION ALL
SELECT 'retention', 'Keep ' || segment || ' customer',
  'Customer ' || customer_id || ': ' || action, 'medium',
  'Contact the customer; Track the next order' FROM retention WHERE priority <> 'low'""")

# -- questions ------------------------------------------------------------------------------------------

# The same over a question about every product, worded by its id.
BLOCKS["product_asked"] = """SELECT 'product-' || p_partkey AS question_id, CASE p_partkey % 6
    WHEN 0 THEN 'Why does ' || p_name || ' sell less?'
    WHEN 1 THEN 'Can you PREDICT ' || p_name || ' for the next weeks?'
    WHEN 2 THEN 'Does our Inventory of ' || p_name || ' last?'
    WHEN 3 THEN 'What would you recommend for ' || p_name || '?'
    WHEN 4 THEN 'Tell me about ' || p_name || '.'
    ELSE 'Will ' || p_name || ' Decrease further, and what of its future?' END AS question
  FROM part"""
BLOCKS["product_intent"] = BLOCKS["intent"].replace("FROM asked", "FROM product_asked")
NEEDS["product_intent"] = ["product_asked"]

ORACLES["product_intent_counts"] = _with("product_intent", """
SELECT intent, count(*) AS n_questions FROM product_intent GROUP BY intent""")

ORACLES["intent_counts"] = _with("intent", """
SELECT intent, count(*) AS n_questions FROM intent GROUP BY intent""")

ORACLES["answers"] = _with("intent state best", """
, names AS (SELECT string_agg(display_name, ', ' ORDER BY rank) AS best FROM best
  WHERE rank <= 2),
corr AS (SELECT CASE WHEN stddev_pop(total_sales) * stddev_pop(inventory_level) > 0
    THEN covar_pop(total_sales, inventory_level)
      / (stddev_pop(total_sales) * stddev_pop(inventory_level)) END AS c FROM wide)
SELECT question_id, intent, CASE intent
  WHEN 'drop' THEN CASE WHEN change_pct < -15 THEN 'Sales fell by '
      || CAST(abs(change_pct) AS DECIMAL(38,1))
      || ' percent against the period before; correlation with stock is '
      || coalesce(CAST(CAST(c AS DECIMAL(38,2)) AS VARCHAR), 'not defined')
      || '; revenue at risk per day is about '
      || CAST(abs(change_pct / 100) * mean_revenue AS DECIMAL(38,0))
    ELSE 'No marked drop: sales changed by ' || CAST(change_pct AS DECIMAL(38,1))
      || ' percent' END
  WHEN 'forecast' THEN 'Expected daily sales are ' || CAST(recent_mean AS DECIMAL(38,0))
      || ', between ' || CAST(recent_mean - std_sales * 1.96 AS DECIMAL(38,0))
      || ' and ' || CAST(recent_mean + std_sales * 1.96 AS DECIMAL(38,0))
  WHEN 'inventory' THEN CASE WHEN days_of_supply < 20
      THEN 'Restock ' || best || ': stock covers ' ELSE 'Stock covers ' END
      || CAST(days_of_supply AS DECIMAL(38,1)) || ' days'
  WHEN 'recommend' THEN 'Strongest categories: ' || best
      || '; change of sales in percent: ' || CAST(change_pct AS DECIMAL(38,1))
      || '; days of supply: ' || CAST(days_of_supply AS DECIMAL(38,1))
  ELSE 'Ask about a sales drop, a forecast, inventory or recommendations' END AS answer,
  round(CASE intent WHEN 'drop' THEN change_pct WHEN 'forecast' THEN recent_mean
    WHEN 'inventory' THEN days_of_supply END, 4) AS measure, 0.85::DOUBLE AS confidence,
  CASE intent WHEN 'drop' THEN 'daily sales; inventory' WHEN 'forecast' THEN 'daily sales'
    WHEN 'inventory' THEN 'inventory; daily sales' WHEN 'recommend' THEN 'category sales'
    ELSE '' END AS sources
FROM intent, state, names, corr""")

ORACLES["product_answers"] = ORACLES["answers"].replace(
    ORACLES["answers"][:ORACLES["answers"].index(", names AS")],
    _with("product_intent state best", "")).replace("FROM intent, state", "FROM product_intent, state")

ORACLES["prompt_context"] = _with("asked total product_total", """
, names AS (SELECT string_agg(product_name, ', ' ORDER BY revenue DESC, product_id) AS names
  FROM (SELECT * FROM product_total ORDER BY revenue DESC, product_id LIMIT 3))
SELECT question_id, concat_ws(chr(10),
  '{"total_revenue":"' || CAST(round(total, 2) AS DECIMAL(38,2))
  || '","recent_revenue":"' || CAST(round(recent, 2) AS DECIMAL(38,2))
  || '","recent_share_pct":"'
  || CAST(recent::DOUBLE / total::DOUBLE * 100 AS DECIMAL(38,0))
  || '","revenue_change_pct":"' || CAST((recent::DOUBLE - previous::DOUBLE)
    / previous::DOUBLE * 100 AS DECIMAL(38,1))
  || '","top_products":"' || names || '"}', history, question)
  AS prompt
FROM asked, total, names""")

# -- streams ----------------------------------------------------------------------------------------------

ORACLES["stream_daily_totals"] = _with("event_day", """
SELECT date, event_type, n_rows, CAST(round(total, 2) AS DOUBLE) AS total FROM event_day""")

# A day is closed, and its totals final, once the newest event is a day past its end.
ORACLES["stream_daily_alerts"] = _with("event_day", """
, base AS (SELECT event_type, sum(total)::DOUBLE / count(*) AS expected
  FROM event_day GROUP BY event_type)
SELECT event_type, date, n_rows, CAST(round(total, 2) AS DOUBLE) AS total,
  round(expected, 4) AS expected,
  round((e.total::DOUBLE - expected) / expected * 100, 4) AS change_pct
FROM event_day e JOIN base USING (event_type)
WHERE (e.total::DOUBLE - expected) / expected * 100 < -10
  AND date + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")

# Stock counts set the stock at the end of their day; other days move it on. A day is
# closed once the newest movement is a day past its end; the stream reports only a change for the worse.
ORACLES["stream_stock_days"] = """
WITH move AS (SELECT l_partkey AS product_id, l_shipdate AS ts, l_orderkey AS line,
    CASE WHEN l_linenumber = 1 THEN 'count' WHEN l_returnflag = 'R' THEN 'receipt'
      ELSE 'sale' END AS kind,
    CASE WHEN l_linenumber = 1 THEN 10 + (l_orderkey * 37 + 1) % 190
      ELSE CAST(l_quantity AS BIGINT) END AS quantity FROM lineitem),
day AS (SELECT product_id, CAST(ts AS DATE) AS date, count(*) AS n_rows,
    CAST(sum(CASE WHEN kind = 'sale' THEN quantity ELSE 0 END) AS BIGINT) AS units,
    CAST(sum(CASE kind WHEN 'sale' THEN -quantity WHEN 'receipt' THEN quantity ELSE 0 END)
      AS BIGINT) AS net,
    max(CASE WHEN kind = 'count' THEN {'ts': ts, 'line': line, 'q': quantity} END).q AS counted
  FROM move GROUP BY 1, 2),
marked AS (SELECT *, count(counted) OVER w AS g,
    sum(units) OVER (PARTITION BY product_id ORDER BY date
      RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) / 30.0::DOUBLE AS recent,
    coalesce(sum(units) OVER (PARTITION BY product_id ORDER BY date
      RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND INTERVAL 30 DAY PRECEDING), 0) / 30.0::DOUBLE AS before,
    date + INTERVAL 2 DAY <= (SELECT max(ts) FROM move) AS closed
  FROM day WINDOW w AS (PARTITION BY product_id ORDER BY date)),
stocked AS (SELECT *, CASE WHEN g > 0 THEN max(counted) OVER (PARTITION BY product_id, g)
    + sum(CASE WHEN counted IS NULL THEN net ELSE 0 END) OVER (
      PARTITION BY product_id, g ORDER BY date) END AS stock FROM marked),
judged AS (SELECT *, CASE WHEN stock IS NULL THEN NULL WHEN recent > 0
    THEN greatest(stock, 0) / recent ELSE 999.0 END AS supply,
    CASE WHEN before > 0 THEN (recent - before) / before * 100 END AS change FROM stocked),
ranked AS (SELECT *, CASE WHEN supply < 15 THEN 2 WHEN supply < 20 THEN 1 ELSE 0 END AS r,
    coalesce(change < -15, FALSE) AS falls FROM judged),
told AS (SELECT *, r > lag(r, 1, 0) OVER w AS worse, falls AND NOT lag(falls, 1, FALSE) OVER w AS drops
  FROM ranked WINDOW w AS (PARTITION BY product_id ORDER BY date))
SELECT product_id, date, closed, n_rows, units,
  CASE WHEN closed THEN CAST(stock AS BIGINT) END AS stock,
  CASE WHEN closed THEN round(recent, 6) END AS mean_demand,
  CASE WHEN closed THEN round(supply, 6) END AS days_of_supply,
  CASE WHEN closed AND supply IS NOT NULL THEN ['healthy', 'low', 'critical'][r + 1] END AS status,
  CASE WHEN closed THEN round(change, 6) END AS change_pct,
  CASE WHEN closed AND worse THEN ['healthy', 'low', 'critical'][r + 1] END AS stock_alert,
  CASE WHEN closed THEN drops END AS drop_alert, 0::BIGINT AS late_rows
FROM told"""

# -- forecasts against the days that followed, stock under a forecast ----------------------

PROJECTED = """
, level AS (SELECT product_id, coalesce(sum(quantity) FILTER (date > d - 30 AND date <= d), 0)
    ::DOUBLE / 30 AS demand, any_value(d) AS d FROM product_day, today GROUP BY product_id),
ahead AS (SELECT product_id, CAST(d + CAST(i AS INTEGER) AS DATE) AS ds, demand
  FROM level, range(1, 31) AS r(i)),
coming AS (SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS ds,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS arrivals
  FROM lineitem, today WHERE l_linenumber = 1 AND CAST(l_shipdate AS DATE) > d GROUP BY 1, 2),
moved AS (SELECT product_id, ds, demand, coalesce(arrivals, 0) AS arrivals, quantity_on_hand
  FROM ahead LEFT JOIN coming USING (product_id, ds) JOIN position USING (product_id)),
free AS (SELECT *, quantity_on_hand + sum(arrivals - demand) OVER (
    PARTITION BY product_id ORDER BY ds) AS free FROM moved),
short AS (SELECT *, greatest(-min(free) OVER (PARTITION BY product_id ORDER BY ds), 0) AS missed
  FROM free),
projected AS (SELECT product_id, ds, demand, CAST(arrivals AS BIGINT) AS arrivals, free + missed AS stock,
    missed - lag(missed, 1, 0) OVER (PARTITION BY product_id ORDER BY ds) AS lost FROM short)"""

ORACLES["stock_projection"] = _with("product_day today position", f"""{PROJECTED}
SELECT product_id, ds, round(demand, 4) AS demand, arrivals, round(stock, 4) AS stock,
  round(lost, 4) AS lost FROM projected""")

ORACLES["restock_plan"] = _with("product_day today position", f"""{PROJECTED},
sums AS (SELECT product_id, sum(demand) AS expected, avg(demand) AS mean,
    CAST(sum(arrivals) AS BIGINT) AS arrivals, sum(lost) AS lost, min(stock) AS lowest,
    min(ds) FILTER (lost > 1e-6) AS stock_out FROM projected GROUP BY product_id)
SELECT product_id, CAST(quantity_on_hand AS BIGINT) AS quantity_on_hand,
  coalesce(arrivals, 0) AS arrivals, round(coalesce(expected, 0), 4) AS expected_demand,
  round(coalesce(lost, 0), 4) AS lost_demand,
  round(coalesce(lowest, greatest(quantity_on_hand, 0)), 4)::DOUBLE AS lowest_stock, stock_out,
  CAST(stock_out - 7 AS DATE) AS order_by, CAST(greatest(0, ceil(round(coalesce(
    expected + mean * 14 - arrivals - quantity_on_hand, 0), 6))) AS BIGINT) AS restock_quantity
FROM position LEFT JOIN sums USING (product_id)""")

COMPARED = """
, span AS (SELECT max(date) AS last FROM region_day),
origin AS (SELECT CAST(last - 30 - 30 * CAST(i AS INTEGER) AS DATE) AS origin
  FROM span, range(0, 6) AS r(i)),
seen AS (SELECT region, origin, total_sales, row_number() OVER (
    PARTITION BY region, origin ORDER BY date DESC) AS age
  FROM region_day, origin WHERE date <= origin),
level AS (SELECT region, origin, sum(total_sales)::DOUBLE / count(total_sales) AS yhat,
    stddev_pop(total_sales::DOUBLE) AS std FROM seen WHERE age <= 30 GROUP BY region, origin),
ahead AS (SELECT region, origin, CAST(origin + CAST(i AS INTEGER) AS DATE) AS ds,
    CAST(i AS INTEGER) AS step, yhat, yhat - std * 1.96 AS lower, yhat + std * 1.96 AS upper
  FROM level, range(1, 31) AS r(i)),
compared AS (SELECT ahead.*, CASE WHEN ds <= last THEN coalesce(total_sales, 0)::DOUBLE END AS actual
  FROM span, ahead LEFT JOIN region_day ON ahead.region = region_day.region AND ds = date)"""

ORACLES["forecast_backtest"] = _with("region_day", f"""{COMPARED}
SELECT region, origin, ds, step, round(yhat, 4) AS yhat, round(lower, 4) AS lower,
  round(upper, 4) AS upper, round(actual, 4) AS actual, actual BETWEEN lower AND upper AS inside
FROM compared""")

ORACLES["forecast_errors"] = _with("region_day", f"""{COMPARED}
SELECT step, count(*) AS n_days, round(avg(yhat - actual), 4) AS bias,
  round(avg(abs(yhat - actual)), 4) AS mae, round(sqrt(avg((yhat - actual) * (yhat - actual))), 4) AS rmse,
  round(sum(abs(yhat - actual)) / nullif(sum(abs(actual)), 0) * 100, 4) AS wape,
  round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS coverage
FROM compared WHERE actual IS NOT NULL GROUP BY step""")

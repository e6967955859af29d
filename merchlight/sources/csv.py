"""CSV sources. Columns bind by header name; values are parsed, never trusted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from merchlight.sources import records

# The CSV layouts (column name to Spark type).
SALES_COLUMNS = {"product_name": "string", "quantity": "int", "revenue": "double",
                 "customer_id": "string", "region": "string", "date": "date"}
INVENTORY_COLUMNS = {"product_name": "string", "quantity_on_hand": "int"}
DAILY_COLUMNS = {"date": "date", "total_sales": "double", "inventory_level": "int",
                 "revenue": "double", "customers": "int"}


#: The raw text of a record that does not have the header's number of fields.
RECORD = "_record"


#: The text of a record as it stands in its file.
RAW = "_raw"


def read_text_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text, named by the header, and ``_record`` for malformed records.

    Quoted line breaks belong to their field, and files may differ in the order of
    their columns: a column is the one of that name in each file's own header, null
    where the file has none. Large files are read by many tasks. ``_raw`` is the
    record's text. ``multi_line=False`` leaves the parsing to Spark's reader, for files
    without quoted line breaks and with one header; it gives no ``_raw``.
    """
    if multi_line:
        found, headers = records.read_records(spark, path)
        names = dict.fromkeys(n for header in headers for n in header)
        return found.select(*[records.named(headers, n).alias(n) for n in names],
                            F.when(~F.col("whole"), F.col("raw")).alias(RECORD),
                            F.col("raw").alias(RAW))
    reader = spark.read.option("header", True).option("enforceSchema", False)
    names = [c for c in reader.csv(path).columns if c != RECORD]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RECORD]])
    return reader.option("columnNameOfCorruptRecord", RECORD).schema(schema).csv(path)


def typed(column: str, kind: str) -> Column:
    """``try_cast``, with NaN as null so that means skip it; dates drop their time."""
    raw = F.trim(F.col(f"`{column}`"))
    if kind == "date":
        return F.when(F.length(raw) <= 10, raw.try_cast("date")) \
                .otherwise(raw.try_cast("timestamp_ntz").cast("date"))
    value = raw.try_cast(kind)
    if kind in ("int", "bigint"):          # a whole number written as 2.0 counts
        real = raw.try_cast("double")
        value = F.coalesce(value, F.when(real == F.floor(real), real.try_cast(kind)))
    return F.when(~F.isnan(value), value) if kind in ("double", "float") else value


def coerce(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The named columns in their types; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[typed(c, k).alias(c) for c, k in columns.items()])


def read_daily_metrics(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Wide daily table: the fixed columns plus every category column, by date."""
    raw = read_text_table(spark, path, multi_line)
    extra = {c: "double" for c in raw.columns if "sales" in c and c not in DAILY_COLUMNS}
    return coerce(raw, {**DAILY_COLUMNS, **extra}).orderBy("date")


def sales_rules() -> dict[str, Column]:
    """What a sale row must satisfy; a null outcome counts as failed."""
    return {
        "product_missing": F.length(F.trim("product_name")) > 0,
        "quantity_invalid": F.col("quantity") > 0,
        "revenue_invalid": F.col("revenue") >= 0,
        "customer_missing": F.length(F.trim("customer_id")) > 0,
        "region_missing": F.length(F.trim("region")) > 0,
        "date_invalid": F.col("date").isNotNull(),
    }


def inventory_rules() -> dict[str, Column]:
    return {"product_missing": F.length(F.trim("product_name")) > 0,
            "quantity_invalid": F.col("quantity_on_hand") >= 0}


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``failed``: the names of the rules a row breaks."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
             for name, ok in rules.items()]
    return df.withColumn("failed", F.array_compact(F.array(*marks)))


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with the names of the broken rules."""
    return (checked.filter(F.size("failed") == 0).drop("failed"),
            checked.filter(F.size("failed") > 0))


def load_sales(spark: SparkSession, path: str, rules: Mapping[str, Column] | None = None,
               multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sales CSV to typed rows; returns (good, rejects with their ``raw`` text)."""
    return _load(spark, path, SALES_COLUMNS, rules or sales_rules(), multi_line)


def load_inventory(spark: SparkSession, path: str, multi_line: bool = True,
                   dated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Inventory CSV to typed rows; returns (good, rejects with their ``raw`` text).

    ``dated``: the files also say when a count was ``last_updated``.
    """
    columns, rules = INVENTORY_COLUMNS, inventory_rules()
    if dated:
        columns = {**columns, "last_updated": "date"}
        rules["date_invalid"] = F.col("last_updated").isNotNull()
    return _load(spark, path, columns, rules, multi_line)


def stock_counts(loaded: DataFrame, products: DataFrame, taken_on=None) -> DataFrame:
    """The newest count of every product: ``product_id, quantity_on_hand, last_updated``.

    What ``latest_inventory`` and ``stock_position`` read. ``taken_on`` is the day of a
    file without dates; of several counts on a day the highest stands. Counts are
    reduced by name before they meet the products; a name that several products share
    counts for each, and names of no product are found by ``unknown_products``.
    """
    day = F.col("last_updated") if taken_on is None else F.lit(str(taken_on)).cast("date")
    newest = loaded.groupBy("product_name").agg(
        F.max(F.struct(day.alias("last_updated"), "quantity_on_hand")).alias("s"))
    return newest.join(products.select("product_id", "product_name"), "product_name").select(
        "product_id", "s.quantity_on_hand", "s.last_updated")


def _load(spark, path, columns, rules, multi_line=True) -> tuple[DataFrame, DataFrame]:
    text = read_text_table(spark, path, multi_line)
    fields = F.struct(*[F.col(f"`{c}`") for c in text.columns if c not in (RECORD, RAW)])
    raw = F.col(RAW) if RAW in text.columns else F.coalesce(F.col(RECORD), F.to_json(fields))
    text = text.withColumns({"raw": raw, "whole": F.col(RECORD).isNull()})
    coerce(text, columns)                  # a missing column is an error
    rows = text.select(*[typed(c, k).alias(c) for c, k in columns.items()], "raw", "whole")
    checked = check_rows(rows, {"record_malformed": F.col("whole"), **rules}).drop("whole")
    good, rejects = split_rows(checked)
    return good.drop("raw"), rejects


def unknown_products(sales: DataFrame, products: DataFrame,
                     on: str = "product_name") -> DataFrame:
    """Sale rows whose product is not in the product table."""
    return sales.join(products.select(on), on, "left_anti")

"""Small column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

# Cost share of revenue, and the days-of-supply value that stands
# for "no demand".
COST_RATIO = 0.6
NO_DEMAND_DAYS = 999.0


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Double division; null where the divisor is zero or missing."""
    return F.try_divide(as_column(top).cast("double"), as_column(bottom).cast("double"))


def mean_of(value: Column | str, where: Column | None = None) -> Column:
    """Mean as sum / count, so decimal input is added exactly before dividing."""
    value = as_column(value)
    if where is not None:
        value = F.when(where, value)
    return ratio(F.sum(value), F.count(value))


def mean_over(value: Column | str, window: WindowSpec) -> Column:
    value = as_column(value)
    return ratio(F.sum(value).over(window), F.count(value).over(window))


def change_pct(new: Column | str, old: Column | str) -> Column:
    """Relative change in percent; 0 where there is nothing to compare with."""
    return F.coalesce(raw_change_pct(new, old), F.lit(0.0))


def raw_change_pct(new: Column | str, old: Column | str) -> Column:
    """Relative change in percent; null where the old value is 0 or missing."""
    new, old = as_column(new).cast("double"), as_column(old).cast("double")
    return F.try_divide(new - old, old) * 100


def money(value: Column | str) -> Column:
    """Round to cents while still decimal, then hand out a double."""
    return F.round(as_column(value), 2).cast("double")


def fixed_text(value: Column | str, digits: int = 2) -> Column:
    """A number as text with a fixed count of decimals (half-up)."""
    return as_column(value).cast(f"decimal(38,{digits})").cast("string")


def ten_thousandths(value: Column | str) -> Column:
    """An amount with up to four decimals as a whole number of ten-thousandths."""
    return F.floor(as_column(value) * 10_000 + 0.5)


def exact_total(units: str) -> Column:
    """Sum of ten-thousandths as an exact decimal(38,4).

    Whole amounts and remainders are added as two longs, which stays in compiled
    hash aggregation and cannot overflow below some 10^13 rows of one key; a decimal
    sum over double input costs about twice as much.
    """
    whole = F.sum(F.expr(f"{units} div 10000")).cast("decimal(28,0)")
    rest = F.sum(F.col(units) % 10_000).cast("decimal(28,0)")
    return (whole + rest * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(38,4)")


def days_of_supply(stock: Column | str, demand: Column | str) -> Column:
    """Stock divided by daily demand; a fixed high value without demand."""
    demand = as_column(demand).cast("double")
    return F.when(demand > 0, ratio(stock, demand)).otherwise(F.lit(NO_DEMAND_DAYS))


def display_name(name: Column | str) -> Column:
    """Category column name without its suffix, first letter capital, rest lower."""
    bare = F.regexp_replace(as_column(name), "_sales$", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)),
                    F.lower(F.substring(bare, 2, 1_000_000)))


def resolve_as_of(df: DataFrame, as_of=None, date: str = "date") -> Column:
    """The reference day as a column: given, or the last date found in ``df``.

    The default is a scalar subquery over ``df``; pass a date or a cheaper
    scalar when ``df`` is the outcome of large joins.
    """
    if as_of is None:
        return df.agg(F.max(date).alias("as_of")).scalar()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def by_keys(keys: Sequence[str]) -> WindowSpec:
    """Window over each series.

    Without keys there is one series; callers hand in day-grain rows only, so
    that the one partition is bounded by the number of days.
    """
    return W.partitionBy(*keys)

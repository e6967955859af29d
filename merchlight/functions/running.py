"""Running totals of long series over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from merchlight.session import stage

#: Bits that ``monotonically_increasing_id`` leaves for the place within a task.
PLACE_BITS = 33


def running_before(df: DataFrame, keys: Sequence[str], order: str, value: str,
                   name: str) -> DataFrame:
    """``df`` with the total of ``value`` (long) over the rows of its keys before each row.

    The rows are sorted by ranges of keys and ``order``, so one series may lie in many
    tasks; each task adds up its own share, and the totals of the shares before are
    added from a table of one row for each task and series in it. ``order`` must be
    unique within a series. Null values count 0; null keys are a series of their own.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(df.repartitionByRange(parts, *keys, order).sortWithinPartitions(*keys, order)
                   .withColumn("_at", F.monotonically_increasing_id()), "running")
    placed = placed.withColumn("_task", F.shiftright("_at", PLACE_BITS))
    series = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"_key{i}")
              for i, k in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(keys))]
    shares = placed.groupBy(*series, "_task").agg(
        F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_sum"))
    earlier = shares.select(*names, "_task", (F.sum("_sum").over(
        Window.partitionBy(*names).orderBy("_task")) - F.col("_sum")).alias("_before"))
    own = Window.partitionBy("_task", *keys).orderBy("_at") \
        .rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inside.select("*", *series).join(earlier, [*names, "_task"]).select(
        *df.columns, (F.col("_before") + F.col("_inside")).alias(name))

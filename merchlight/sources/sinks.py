"""Writing result tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, format: str = "parquet",
                partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write as Parquet, CSV (with header), JSON or ORC.

    Partition columns cluster the rows first, so a value is written by few tasks;
    the split of a large value over several tasks is left to the adaptive
    rebalance rather than one task per value.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def with_month(df: DataFrame, date: str = "date") -> DataFrame:
    """Month as text, the usual partition column of the fact."""
    return df.withColumn("month", F.date_format(date, "yyyy-MM"))


def write_records(records: DataFrame, path: str, header: str, mode: str = "errorifexists") -> None:
    """Write a text column as it is, one record after the other, under a header in each file.

    For CSV whose records are formed elsewhere; a record may hold line breaks.
    """
    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([header])], names=["value"])
        for batch in batches:
            yield pa.record_batch([batch.column(0)], names=["value"])

    records.mapInArrow(headed, "value string").write.mode(mode).text(path)

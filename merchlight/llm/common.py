"""Shared pieces of the training-data operators: staging, input columns, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from merchlight.session import new_path, shared_dir

__all__ = ["documents", "discard", "keyed_text", "new_path", "pieces", "put", "shared_dir", "slices",
           "table"]

#: Bytes of text that a task holds as arrays at one time (a longer text comes alone).
SLICE_BYTES = 1 << 20
#: Rows of a batch that are Python values at one time.
PIECE_ROWS = 256


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under the names ``doc_id`` (long) and ``text``."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.col(text_col).cast("string").alias("text"))


def put(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage.

    The shuffle files of the write go at its end, as nothing reads them any more; left to
    Spark they stay until the driver happens to collect its garbage.
    """
    path = new_path(df.sparkSession, f"llm-{label}")
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before) if before else conf.unset(name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove tables made by ``put`` that nothing reads any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, for what turns whole batches into Python values."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together stay under the limit, or hold a single text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as bytes; null becomes empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs begins, and the end of the last one."""
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every run, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)

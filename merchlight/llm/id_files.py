"""Token ids of documents in files of range-coded chunks.

Documents are sorted by id over all tasks and tokenised; each task writes chunks of
whole documents, one row each: task, place in the task, the documents' ids and
lengths, and the coded ids of all of them. The files are written by Spark's own
committer, so a lost executor leaves no partial chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from merchlight.llm.common import keyed_text, slices, starts_of, utf8
from merchlight.llm.range_coder import decode, encode
from merchlight.llm.tokens import encoder

#: Ids of a chunk that close it (a longer document makes a longer one).
CHUNK_IDS = 1 << 22
SCHEMA = "task int, chunk int, doc_ids array<long>, lengths array<long>, n_ids long, ids binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text (null: empty), each ended by ``end_id``.

    Ascending by document id, rows without id first; rows of one id are ordered by
    their text's hash. Other columns are ignored; an empty table makes no chunk.
    """
    rows = keyed_text(docs, id_col, text_col).withColumn("x", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "x") \
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "x").select("doc_id", "text")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        tokens, task, made = encoder(tokenizer), TaskContext.get().partitionId(), 0
        vocabulary = max(tokens.library.get_vocab_size(), end_id + 1)
        docs, held, size = [], [], 0

        def chunk():
            ids = np.concatenate(held)
            return pa.record_batch(
                [pa.array([task], pa.int32()), pa.array([made], pa.int32()),
                 pa.array([docs], pa.list_(pa.int64())),
                 pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                 pa.array([len(ids)], pa.int64()),
                 pa.array([encode(ids, vocabulary)], pa.binary())],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            texts, keys = utf8(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in slices(texts, 2 << 20):
                ids, first = tokens.encode(texts[lo:hi])
                for i in range(hi - lo):
                    held.append(np.append(ids[first[i]:first[i + 1]], np.uint32(end_id)))
                    docs.append(keys[lo + i])
                    size += len(held[-1])
                    if size >= CHUNK_IDS:
                        yield chunk()
                        docs, held, size, made = [], [], 0, made + 1
        if held:
            yield chunk()

    rows.mapInArrow(coded, SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files' ids.

    ``start`` adds up the chunks' lengths: within a task by chunk, over tasks on one
    row for each task.
    """
    chunks = spark.read.schema(SCHEMA).parquet(path)
    tasks = chunks.groupBy("task").agg(F.sum("n_ids").alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n"))
                         .alias("before"))
    inside = Window.partitionBy("task").orderBy("chunk")
    places = chunks.select("task", "chunk", (F.sum("n_ids").over(inside) - F.col("n_ids"))
                           .alias("within")).join(tasks, "task") \
        .select("task", "chunk", (F.col("before") + F.col("within")).alias("base"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch.column(3)[i].as_py()).astype("<u4")
                lengths = np.asarray(batch.column(2)[i].values)
                at = starts_of(lengths)
                n = len(lengths)
                yield pa.record_batch(
                    [pa.array(np.repeat(np.asarray(batch.column(0))[i:i + 1], n)),
                     pa.array(np.repeat(np.asarray(batch.column(4))[i:i + 1], n)),
                     batch.column(1)[i].values, pa.array(at[:-1]), pa.array(lengths),
                     pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])],
                              pa.int64())],
                    names=["task", "chunk", "doc_id", "own", "n_tokens", "ids_crc32"])

    docs = chunks.select("task", "doc_ids", "lengths", "ids", "chunk").mapInArrow(
        opened, "task int, chunk int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["task", "chunk"]).select(
        "doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")

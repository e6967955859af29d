"""Packing of tokenised documents into sequences of fixed capacity.

Lengths are at most the capacity, so the packing is planned on the number of pieces
of each length, a table whose size depends on the capacity alone. Pieces above a
third of the capacity are matched first, the longest with the longest that still
fits; no more than two of them share a sequence. Shorter ones then go, longest
first, into the tightest gap that holds them. The plan says where the n-th piece of
every length goes; pieces are numbered within their length by windows over buckets
of bounded size, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from merchlight.llm.common import keyed_text, put, slices, utf8
from merchlight.llm.tokens import encoder

#: Pieces in one numbering bucket, on average.
BUCKET = 200_000


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places.

    A document is the ids of its whole text (null: empty) and ``end_id``. Longer ones
    than ``capacity`` are cut into full pieces after a first one that holds the rest.
    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Every input row is a document of its own, also repeated rows and rows without id.
    Other columns are ignored; an empty table gives an empty result.
    """
    pieces = put(token_pieces(keyed_text(docs, id_col, text_col), tokenizer, capacity, end_id),
                 "pieces")
    return place(pieces, capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                tokens, first = encode(texts[lo:hi])
                rows = []
                for i in range(hi - lo):
                    own = np.append(tokens[first[i]:first[i + 1]], np.uint32(end_id))
                    stops = range(len(own) % capacity or capacity, len(own) + 1, capacity)
                    at = 0
                    for k, stop in enumerate(stops):
                        crc = zlib.crc32(own[at:stop].astype("<u4").tobytes())
                        rows.append((ids[lo + i], k, at, stop - at, crc))
                        at = stop
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), KINDS)],
                                      names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths from 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():     # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    plan = plan_sequences(counts, capacity)
    keys = (plan[:, 0] << 40) | plan[:, 1]
    buckets = int(counts.sum()) // BUCKET + 16
    numbered = pieces.withColumn("_bucket", F.pmod(F.xxhash64(
        "doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = numbered.groupBy("length", "_bucket").count().withColumn(
        "_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) -
        F.col("count")).drop("count")
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = numbered.withColumn("_n", F.row_number().over(own)) \
        .join(before, ["length", "_bucket"]) \
        .select(*pieces.columns, (F.col("_before") + F.col("_n") - 1).alias("_rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            at = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            sequence = plan[at, 3] + rank - plan[at, 1] if len(plan) else rank
            offset = plan[at, 4] if len(plan) else rank
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence, pa.int64()),
                                   pa.array(offset, pa.int64())], names=[
                *batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def plan_sequences(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows ``length, first rank, number, first sequence, offset``, by length and rank."""
    left = counts.copy()
    shapes: list[list] = []                     # [number of sequences, lengths in them]
    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b > third and left[b] < 1 + (a == b):
                b -= 1
            if b <= third:
                shapes.append([int(left[a]), [a]])
                left[a] = 0
                break
            n = int(left[a] // 2 if a == b else min(left[a], left[b]))
            shapes.append([n, [a, b]])
            left[a] -= n
            left[b] -= n
    gaps: list[list] = [[] for _ in range(capacity + 1)]
    present = 0                                 # bit g: there are sequences with gap g
    for shape in shapes:
        gap = capacity - sum(shape[1])
        gaps[gap].append(shape)
        present |= 1 << gap
    for a in range(third, 0, -1):
        while left[a]:
            rest = present >> a
            if not rest:
                each = capacity // a
                for n, k in ((int(left[a] // each), each), (1, int(left[a] % each))):
                    if n and k:
                        gaps[capacity - k * a].append([n, [a] * k])
                        present |= 1 << (capacity - k * a)
                left[a] = 0
                break
            gap = a + (rest & -rest).bit_length() - 1
            shape = gaps[gap][-1]
            n = int(min(left[a], shape[0]))
            shape[0] -= n
            left[a] -= n
            if not shape[0]:
                gaps[gap].pop()
                present &= ~(0 if gaps[gap] else 1 << gap)
            gaps[gap - a].append([n, [*shape[1], a]])
            present |= 1 << (gap - a)
    rows, sequence, rank = [], 0, np.zeros(capacity + 1, np.int64)
    for shape in (s for g in gaps for s in g):
        offset = 0
        for a in shape[1]:
            rows.append((a, rank[a], shape[0], sequence, offset))
            rank[a] += shape[0]
            offset += a
        sequence += shape[0]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)

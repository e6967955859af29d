"""Packing of neighbouring documents along a Hilbert curve.

A document's vector counts its token ids, damped by logarithms and weighted by the
logarithm of the id: vocabularies number their pieces in the order of the merges, so
an id stands for its rank of frequency. Ids are hashed to signed directions of a few
dimensions, the sum is scaled to unit length, and its place on the Hilbert curve
through these dimensions is the sort key. Every task takes a range of the curve and
lays its documents end to end, so that sequences hold neighbours; they are cut where a
sequence is full. What is left at a task's end is cut at the powers of two, which need
no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchlight.llm.common import keyed_text, put, slices, starts_of, utf8
from merchlight.llm.tokens import encoder
from merchlight.llm.words import U64, mix

#: Dimensions of the curve and bits of each: a key has their product, below 63.
DIMENSIONS, BITS = 4, 15
#: Fixed slope at which the logistic curve is nearest to the normal distribution.
NORMAL_SLOPE = 1.702

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def pack_neighbours(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 0,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places, neighbours on the curve together.

    A document is the ids of its whole text (null: empty) and ``end_id``. All
    sequences are full but for the last ones of a task, whose lengths are powers of
    two. Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. Every input row is a document of its own, also repeated rows and rows
    without id; equal texts lie side by side. Other columns are ignored; an empty
    table gives an empty result.
    """
    keyed = put(curve_keys(keyed_text(docs, id_col, text_col), tokenizer, end_id), "curve")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "ids_crc32", F.asc_nulls_first("doc_id"), "salt"]
    along = keyed.withColumn("salt", F.monotonically_increasing_id()) \
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return along.select("doc_id", "n_ids", "ids").mapInArrow(_laid_out(capacity), PIECES)


def curve_keys(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """``doc_id, key, ids_crc32, n_ids, ids`` of (doc_id, text).

    ``ids`` are those of the text and ``end_id`` as little-endian words of one size.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = len(encode.edge)
        words = word_type(max(width, end_id + 1))
        table = directions(width)
        end = np.array([end_id], words)
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for lo, hi in slices(texts, 2 << 20):
                tokens, first = encode.encode(texts[lo:hi])
                keys = hilbert_keys(quantised(document_vectors(tokens, first, table)))
                raw = [np.append(tokens[a:b].astype(words), end).tobytes()
                       for a, b in zip(first, first[1:])]
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array(keys),
                     pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                     pa.array(np.diff(first) + 1, pa.int64()), pa.array(raw, pa.binary())],
                    names=["doc_id", "key", "ids_crc32", "n_ids", "ids"])

    return docs.mapInArrow(
        keyed, "doc_id long, key long, ids_crc32 long, n_ids long, ids binary")


def word_type(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


# -- vectors and keys ------------------------------------------------------------------


def directions(width: int) -> np.ndarray:
    """For every id its weighted direction: a hashed normal number for each dimension."""
    ids = np.arange(width, dtype=U64)
    out = np.empty((DIMENSIONS, width))
    for d in range(DIMENSIONS):
        u, v = (1 + (mix(ids + U64((2 * d + k) << 32 | 1)) >> U64(11)).astype(float)
                for k in (0, 1))
        out[d] = np.sqrt(-2 * np.log(u / 2.0 ** 53)) * np.cos(2 * np.pi * v / 2.0 ** 53)
    return out * np.log2(2.0 + np.arange(width))


def document_vectors(tokens: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One row of the dimensions for every document; zeros without ids.

    Scaled by the length of the vector before projection, so that each coordinate
    varies like a standard normal number over the choice of directions.
    """
    n, width = len(first) - 1, table.shape[1]
    owner = np.repeat(np.arange(n), np.diff(first))
    cells, times = np.unique(owner * width + tokens, return_counts=True)
    owner, token = cells // width, cells % width
    damped = 1 + np.log(times)
    norm = np.sqrt(np.bincount(owner, (damped * np.log2(2.0 + token)) ** 2, n))
    out = np.stack([np.bincount(owner, damped * row[token], n) for row in table], 1)
    return out / np.maximum(norm, 1e-300)[:, None]


def quantised(vectors: np.ndarray) -> np.ndarray:
    """Coordinates as whole numbers of ``BITS`` bits, by their normal quantile."""
    share = 1 / (1 + np.exp(-NORMAL_SLOPE * np.clip(vectors, -30, 30)))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points (rows of coordinates) on the Hilbert curve through their cube.

    From the coarsest bit down, each point's octant says how the finer bits are turned:
    mirrored where its coordinate's bit is set, else swapped with the first axis. The
    turned bits, undone from Gray code, are the digits of the place.
    """
    axes = [points[:, d].copy() for d in range(points.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d, axis in enumerate(axes):
            inside = (axis >> bit & 1).astype(bool)
            swap = np.where(inside, 0, (axes[0] ^ axis) & low)
            axes[0] = axes[0] ^ np.where(inside, low, swap)
            axes[d] = axes[d] ^ (swap if d else 0)
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    turn = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    keys = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = keys << 1 | (axis ^ turn) >> bit & 1
    return keys


# -- laying out ----------------------------------------------------------------------


def _laid_out(capacity: int):
    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sequence = TaskContext.get().partitionId() << 40
        held, room = [], capacity               # pieces of the sequence that is not full yet
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc, n, raw = (batch.column(c)[i].as_py() for c in range(3))
                own, at = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4"), 0
                while n - at >= room:
                    held.append((doc, at, own[at:at + room], n))
                    at += room
                    rows += _sequence(held, sequence)
                    held, room, sequence = [], capacity, sequence + 1
                if at < n:
                    held.append((doc, at, own[at:], n))
                    room -= n - at
            yield _batch(rows)
        rows, left = [], capacity - room
        while left:
            share = 1 << (left.bit_length() - 1)
            part, held = _split(held, share)
            rows += _sequence(part, sequence)
            sequence, left = sequence + 1, left - share
        yield _batch(rows)

    return laid


def _split(held: list[tuple], share: int) -> tuple[list[tuple], list[tuple]]:
    """Pieces of the first ``share`` ids, and the rest; one piece may be cut in two."""
    part = []
    for k, (doc, start, own, n) in enumerate(held):
        if len(own) > share:
            cut = [(doc, start, own[:share], n)] if share else []
            return part + cut, [(doc, start + share, own[share:], n), *held[k + 1:]]
        part.append((doc, start, own, n))
        share -= len(own)
    return part, []


def _sequence(held: list[tuple], sequence: int) -> list[tuple]:
    rows, offset = [], 0
    for doc, start, own, n in held:
        rows.append((doc, start, len(own), zlib.crc32(own.tobytes()), n, sequence, offset))
        offset += len(own)
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

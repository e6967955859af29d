"""Exact repeats of byte strings by suffix sorting in two stages.

A string of ``width`` bytes that starts in two places is found in three steps. Every
start of such a string has an anchor, the place of the smallest hash of ``GRAM``
bytes inside the string; equal strings have equal anchors, so only starts whose
anchor hash occurs again can repeat. The text around these, split by anchor hash, is
shuffled, and each task sorts the suffixes of some groups at a time: suffixes smaller
than their successor directly, the others by one scan over buckets of first bytes
that places each suffix when its successor is met. Neighbours in the order with a
common prefix of ``width`` bytes are repeats.

An anchor hash with very many places is sorted in lanes of bounded size; their
distinct strings are then matched across lanes by digest. Rows with equal texts are
one text to all this, and are repeats of each other as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchlight.llm.common import keyed_text, put, ragged, slices, utf8
from merchlight.llm.words import BASE, BASE_INVERSE, BYTE_VALUES, U64, mix, powers

WIDTH, GRAM = 200, 24
#: Places of an anchor hash in one lane; starts that a task sorts at a time.
LANE, BLOCK = 1000, 200_000


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                   width: int = WIDTH) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a string of ``width`` bytes that covers it starts anywhere else in
    the table. Null and empty texts have no bytes. Repeated rows repeat each other, with
    or without id. Other columns are ignored; an empty table gives an empty result.
    """
    texts = keyed_text(docs, id_col, text_col).withColumn("t", F.unhex(F.md5("text")))
    anchors = put(_anchors(texts.where("text IS NOT NULL"), width), "anchors")
    kinds = put(anchors.groupBy("t").agg(F.count("*").alias("n"), F.min("doc_id").alias("w"),
                                         F.first("places").alias("places")), "texts")
    places = put(kinds.select("t", F.explode("places").alias("p")).select("t", "p.*"), "places")
    again = put(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "again")
    wanted = put(places.join(again, "h").groupBy("t").agg(F.collect_list(F.struct(
        "h", "lo", "hi", "n")).alias("wanted")).join(kinds.select("t", "w"), "t"), "wanted")
    pieces = texts.join(wanted.withColumnRenamed("t", "wt"), (F.col("t") == F.col("wt")) & (
        F.col("doc_id").eqNullSafe(F.col("w")))).select("t", "text", "wanted")
    found = put(_sorted_groups(_segments(pieces, width), width), "repeats")
    across = found.where("digest IS NOT NULL").groupBy("digest").agg(
        F.collect_list(F.struct("t", "lo", "hi")).alias("x")).where(F.size("x") > 1) \
        .select(F.explode("x").alias("x")).select("x.*")
    runs = found.where("digest IS NULL").select("t", "lo", "hi").union(across) \
        .groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    whole = kinds.where("n > 1").select("t", F.array(F.struct(
        F.lit(0).cast("long").alias("lo"), F.lit(2**62).alias("hi"))).alias("runs"))
    marks = put(runs.join(whole.select("t"), "t", "left_anti").union(whole), "marks")
    return _cut(texts.join(marks, "t", "left").select("doc_id", "text", "runs"), width)


def _anchors(texts: DataFrame, width: int) -> DataFrame:
    """``t, doc_id, places``: per anchor its hash and the first and last start it serves."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = utf8(batch.column(1))
            for lo, hi in slices(data):
                h, first, last, owner = anchors_of(data[lo:hi], width)
                count = np.bincount(owner, minlength=hi - lo)
                items = pa.StructArray.from_arrays(
                    [pa.array(h), pa.array(first), pa.array(last)], names=["h", "lo", "hi"])
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
                yield pa.record_batch(
                    [batch.column(2).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(offsets, items).cast(kind)],
                    names=["t", "doc_id", "places"])

    return texts.select("doc_id", "text", "t").mapInArrow(
        found, "t binary, doc_id long, places array<struct<h long, lo long, hi long>>")


def anchors_of(texts: list[bytes], width: int):
    """Hash, first and last start, and text of every anchor of the texts, in order."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = raw.size - GRAM + 1
    if raw.size < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    summed = np.zeros(raw.size + 1, U64)
    np.cumsum(BYTE_VALUES[raw] * powers(BASE, raw.size), out=summed[1:])
    hashes = mix((summed[GRAM:] - summed[:-GRAM]) * powers(BASE_INVERSE, raw.size)[:n])
    bits = U64(int(n).bit_length())
    least = (hashes >> bits << bits) | np.arange(n, dtype=U64)
    span, reach = width - GRAM + 1, 1          # the smallest of ``span`` neighbours
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:len(least) - (span - reach)], least[span - reach:])
    anchor = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    starts = np.maximum(size - width + 1, 0)
    place = ragged(begin[:-1], starts)
    owner = np.repeat(np.arange(len(texts)), starts)
    own = anchor[place]
    cut = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    end = np.append(cut[1:], len(own)) - 1
    base = begin[owner[cut]]
    return hashes[own[cut]].view(np.int64), place[cut] - base, place[end] - base, owner[cut]


def _segments(pieces: DataFrame, width: int) -> DataFrame:
    """``h, lane, lanes, t, lo, bytes``: the bytes of all strings that start at an anchor."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2)
            for i, text in enumerate(utf8(batch.column(1))):
                rows = wanted[i].values
                h, lo, hi, n = (np.asarray(rows.field(k)) for k in range(4))
                lanes = -(-n // LANE)
                lane = (mix(lo.astype(U64) ^ U64(int.from_bytes(ids[i][:8], "big"))) %
                        lanes.astype(U64)).astype(np.int64)
                yield pa.record_batch(
                    [pa.array(h), pa.array(lane), pa.array(lanes), pa.array([ids[i]] * len(h)),
                     pa.array(lo), pa.array([text[a:b + width] for a, b in
                                             zip(lo.tolist(), hi.tolist())], pa.binary())],
                    names=["h", "lane", "lanes", "t", "lo", "bytes"])

    return pieces.mapInArrow(
        cut, "h long, lane long, lanes long, t binary, lo long, bytes binary")


def _sorted_groups(segments: DataFrame, width: int) -> DataFrame:
    """Repeated ranges ``t, lo, hi``; with a digest, strings to match across lanes."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.repartition(parts, "h", "lane").sortWithinPartitions("h", "lane")

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, starts = [], None, 0
        for batch in batches:
            h, lane, lanes, lo = (np.asarray(batch.column(k)) for k in (0, 1, 2, 4))
            ids, data = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            for i in range(batch.num_rows):
                key = (h[i], lane[i])
                if key != last and starts >= BLOCK:
                    yield from _block(held, width)
                    held, starts = [], 0
                last = key
                held.append((ids[i], lo[i], data[i], lanes[i] > 1))
                starts += len(data[i]) - width + 1
        if held:
            yield from _block(held, width)

    return rows.mapInArrow(repeats, "t binary, lo long, hi long, digest binary")


def _block(held: list, width: int) -> Iterator[pa.RecordBatch]:
    data = [x[2] for x in held]
    order, equal, text, begin, owned = suffix_order(data, width)
    repeat = np.zeros(len(text), bool)
    repeat[order[:-1][equal]] = True
    repeat[order[1:][equal]] = True
    place = ragged(begin, owned)
    segment = np.repeat(np.arange(len(held)), owned)
    base = np.array([x[1] for x in held], np.int64)
    hit = np.flatnonzero(repeat[place])
    if len(hit):
        cut = np.flatnonzero((np.diff(hit, prepend=-2) != 1) |
                             (np.diff(segment[hit], prepend=-1) != 0))
        end = hit[np.append(cut[1:], len(hit)) - 1]
        start, s = hit[cut], segment[hit[cut]]
        yield _found([held[k][0] for k in s], base[s] + place[start] - begin[s],
                     base[s] + place[end] - begin[s] + width, None)
    shared = np.array([x[3] for x in held], bool)
    if shared.any():
        # one start for each distinct string of the groups that have several lanes
        owner = np.full(len(text), -1)
        owner[place] = segment
        fresh = order[np.concatenate(([True], ~equal))]
        fresh = fresh[shared[owner[fresh]]]
        raw, s = text.tobytes(), owner[fresh]
        at = base[s] + fresh - begin[s]
        yield _found([held[k][0] for k in s], at, at + width,
                     [hashlib.md5(raw[p:p + width]).digest() for p in fresh.tolist()])


def _found(ids, lo, hi, digest) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(ids, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
         pa.array(digest or [None] * len(ids), pa.binary())], names=["t", "lo", "hi", "digest"])


def suffix_order(data: list[bytes], width: int):
    """The starts of ``width``-byte strings of all pieces in the order of their strings.

    Returns the order (places in the joined text), whether each equals the next, the
    joined text, and every piece's begin and number of starts.
    """
    size = np.fromiter(map(len, data), np.int64, len(data))
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    owned = size - width + 1
    text = np.frombuffer(b"\0".join([*data, bytes(width + 8)]), np.uint8)
    n = int(begin[-1] + size[-1] + 1)
    # a suffix is smaller than its successor if the next other byte is larger
    change = np.append(np.flatnonzero(text[1:n] != text[:n - 1]), n - 1)
    ahead = change[np.searchsorted(change, np.arange(n))]
    rising = text[ahead + 1] > text[:n]
    rising[begin + size] = True                # the marks between pieces
    wanted = np.zeros(n, bool)
    wanted[ragged(begin, owned)] = True
    # a falling start needs its successors up to a rising one
    stop = np.flatnonzero(rising)
    last = begin + owned - 1
    wanted[ragged(last, stop[np.searchsorted(stop, last)] - last + 1)] = True
    direct = np.flatnonzero(wanted & rising)
    keys = np.lib.stride_tricks.sliding_window_view(text, width)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{width}").ravel(),
                               kind="stable")]
    byte_of = text[direct]
    edges = np.searchsorted(byte_of, np.arange(257))
    falling = np.append(wanted & ~rising, False)
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def place(found: np.ndarray, byte: int) -> np.ndarray:
        """Put the falling predecessors into their buckets; those of this one come back."""
        order.append(found)
        before = found - 1
        before = before[falling[before]]
        first = text[before]
        stays = before[first == byte]
        others = np.flatnonzero(first > byte)
        others = others[np.argsort(first[others], kind="stable")]
        lows, where = np.unique(first[others], return_index=True)
        for low, part in zip(lows.tolist(), np.split(before[others], where[1:])):
            queue[low].append(part)
        return stays

    for byte in range(256):
        while queue[byte]:
            found = np.concatenate(queue[byte])
            queue[byte] = []
            stays = place(found, byte)
            if len(stays):
                queue[byte].append(stays)
        if edges[byte + 1] > edges[byte]:
            place(direct[edges[byte]:edges[byte + 1]], byte)
    order = np.concatenate(order)
    starts = np.zeros(n, bool)
    starts[ragged(begin, owned)] = True
    order = order[starts[order]]
    eights = np.ascontiguousarray(
        np.lib.stride_tricks.sliding_window_view(text, 8)).view(np.uint64).ravel()
    same = np.arange(len(order) - 1)
    for k in [*range(0, width - 7, 8), width - 8]:
        same = same[eights[order[same] + k] == eights[order[same + 1] + k]]
    equal = np.zeros(max(len(order) - 1, 0), bool)
    equal[same] = True
    return order, equal, text, begin, owned


def _cut(rows: DataFrame, width: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, runs = [], batch.column(2)
            for i, text in enumerate(utf8(batch.column(1))):
                n, gone, spans, parts, at = len(text), 0, 0, [], 0
                if runs[i].is_valid and n >= width:
                    x = runs[i].values
                    lo, hi = (np.asarray(x.field(k)) for k in range(2))
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(np.minimum(hi[order], n))
                    new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                    for a, b in zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist()):
                        parts.append(text[at:a])
                        at, gone, spans = b, gone + b - a, spans + 1
                kept = b"".join([*parts, text[at:]])
                out.append((n, gone, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]),
                 pa.array(cols[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                "kept_sha256 string")

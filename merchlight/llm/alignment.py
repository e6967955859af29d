"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide link counts.

Both vocabularies (byte-level BPE, and pieces with byte fallback) cut a text at every
single space or line break between words, so a text's alignment is that of its words
in turn, each with the white space before it; a worker aligns a distinct word once.
Other texts are encoded whole.

The places where tokens of both sides end cut the bytes into groups. A group of one
token each whose ids are linked by the identity map (the second vocabulary's id of the
same bytes) is counted in a vector as long as the first vocabulary, and looked up in
one. Only the links of other groups are pairs: they are added up by pair, frequent
pairs (a table of bounded size) are looked up like the vector, and rare ones meet their
counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchlight.llm.common import SLICE_BYTES, discard, keyed_text, put, ragged, slices, starts_of, utf8
from merchlight.llm.tokens import CODES, LINE_WORDS
from merchlight.llm.words import SPACE, U64, mix, words_of

MARK = "▁"
#: Distinct words a worker keeps before it starts anew.
KEPT_WORDS = 250_000
#: Documents whose ids a task holds as arrays at one time.
STEP = 500
#: Most frequent pairs that every worker gets; their number never exceeds this.
KNOWN_PAIRS = 1 << 16
#: White space beyond TAB to CR and space, and the space mark.
UNUSUAL = set(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                        0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) | {MARK}

DOCS = ("_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, exact binary, pairs array<long>, times array<long>")


def align(docs: DataFrame, tokenizer_a: str, model_b: str, *, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per input row: tokens, groups and links, and the links' corpus counts.

    Columns: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    ``n_best`` counts the links whose pair is the most frequent of its B id, ties
    included; ``count_sum`` adds the pairs' counts over all links. Null or empty texts,
    and texts that the tokens of one side do not spell, have zeros and no digest ('').
    Repeated rows and rows without id count like others; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = keyed_text(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    found = put(_aligned(rows, tokenizer_a, model_b), "aligned")
    totals = put(pair_counts(found, tokenizer_a, model_b), "pair-counts")
    least = _frequent(totals)
    known = totals.where(f"exact OR count >= {least}").toArrow()
    partial = put(_looked_up(found, known, tokenizer_a, model_b), "links")
    rare = partial.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")) \
        .select("_row", "p.pairs", "p.times")
    told = rare.join(totals.where(f"NOT exact AND count < {least}")
                     .withColumnRenamed("pair", "pairs"), "pairs") \
        .groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_b"),
                             F.sum(F.col("times") * F.col("count")).alias("_c"))
    out = partial.drop("pairs", "times").join(told, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("_b", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_c", F.lit(0))).alias("count_sum"), "groups_sha256")
    discard(found)
    return out


# -- counts over the corpus ------------------------------------------------------------


def pair_counts(found: DataFrame, tokenizer_a: str, model_b: str) -> DataFrame:
    """``pair, exact, count, best`` of all id pairs: links over the whole table."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(tokenizer_a, model_b)
        vector = np.zeros(len(both.same), np.int64)
        for batch in _steps(batches):
            ids, _ = _ids_of(batch.column(0), both.words)
            vector += np.bincount(ids, minlength=len(vector))
            pairs, at = np.unique(np.asarray(batch.column(1).flatten()), return_inverse=True)
            times = np.asarray(batch.column(2).flatten())
            n = np.bincount(at, times, len(pairs)).astype(np.int64)
            yield _counted(pairs, both.is_same(pairs), n)
        ids = np.flatnonzero(vector)
        yield _counted(ids << ID_BITS | both.same[ids], np.ones(len(ids), bool), vector[ids])

    counts = found.select("exact", "pairs", "times") \
        .mapInArrow(added, "pair long, exact boolean, n long") \
        .groupBy("pair", "exact").agg(F.sum("n").alias("count")) \
        .withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "exact", "count",
                                         (F.col("count") == F.col("most")).alias("best"))


def _counted(pairs, exact, n) -> pa.RecordBatch:
    return pa.record_batch([pa.array(pairs, pa.int64()), pa.array(exact, pa.bool_()),
                            pa.array(n, pa.int64())], names=["pair", "exact", "n"])


def _frequent(totals: DataFrame) -> int:
    """The least power of two such that at most ``KNOWN_PAIRS`` other pairs reach it."""
    sizes = totals.where("NOT exact").groupBy(
        F.floor(F.log2("count")).cast("int").alias("k")).count().collect()   # at most 63 rows
    least, held = 63, 0
    for k, n in sorted(((r["k"], r["count"]) for r in sizes), reverse=True):
        held += n
        if held > KNOWN_PAIRS:
            break
        least = k
    return 1 << min(least, 62)


def _looked_up(found: DataFrame, known: pa.Table, tokenizer_a: str, model_b: str) -> DataFrame:
    """Documents with the sums over known pairs, and their pairs that are not known."""
    known = known.sort_by("pair")
    keys, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(tokenizer_a, model_b)
        counts, bests = both.vectors(keys, count, best)
        for batch in _steps(batches):
            ids, first = _ids_of(batch.column("exact"), both.words)
            pairs, times = (np.asarray(batch.column(c).flatten()) for c in ("pairs", "times"))
            lists = starts_of(np.asarray(batch.column("pairs").value_lengths()))
            at = np.searchsorted(keys, pairs)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == pairs[hit]
            links, tops = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            links[hit] = times[hit] * count[at[hit]]
            tops[hit] = times[hit] * best[at[hit]]
            rest = starts_of(~hit)[lists]
            n_best = _sums(bests[ids], first) + _sums(tops, lists)
            count_sum = _sums(counts[ids], first) + _sums(links, lists)
            yield pa.record_batch(
                [*(batch.column(c) for c in KEPT), pa.array(n_best), pa.array(count_sum),
                 _lists(pairs[~hit], rest), _lists(times[~hit], rest)],
                names=[*KEPT, "n_best", "count_sum", "pairs", "times"])

    return found.mapInArrow(looked_up, "_row long, doc_id long, n_a long, n_b long, n_groups long, "
                                       "n_links long, groups_sha256 string, n_best long, "
                                       "count_sum long, pairs array<long>, times array<long>")


KEPT = ["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _ids_of(column: pa.Array, words: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column, and where each row's begin."""
    raw = column.to_pylist()
    ids = np.frombuffer(b"".join(raw), words)
    return ids, starts_of(np.fromiter(map(len, raw), np.int64, len(raw))) // ids.itemsize


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = starts_of(values)
    return total[first[1:]] - total[first[:-1]]


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int64()))


# -- alignment of texts ----------------------------------------------------------------


def _aligned(docs: DataFrame, tokenizer_a: str, model_b: str) -> DataFrame:
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(tokenizer_a, model_b)
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in slices(texts, SLICE_BYTES // 4):
                yield pa.record_batch(
                    [batch.column(2).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo),
                     *both.align(texts[lo:hi])], names=[c.split()[0] for c in DOCS.split(", ")])

    return docs.mapInArrow(aligned, DOCS)


#: Bits of a pair that hold the B id.
ID_BITS = 20


class Ragged:
    """Values of many slots, one flat array."""

    def __init__(self, dtype):
        self.flat = np.zeros(0, dtype)
        self.first = self.size = np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate((self.first, len(self.flat) + starts_of(size)[:-1]))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat.astype(self.flat.dtype)))

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots' values one after the other, and how many each has."""
        size = self.size[slots]
        return self.flat[ragged(self.first[slots], size)], size


@lru_cache(maxsize=2)
def aligner(tokenizer_a: str, model_b: str) -> Aligner:
    """The worker's aligner of two tokenizer files."""
    return Aligner(tokenizer_a, model_b)


class Aligner:
    """``same[a]``: the B id of the same bytes as A's id, or -1."""

    def __init__(self, tokenizer_a: str, model_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(tokenizer_a), SentencePieceProcessor(
            model_file=model_b)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core
        self.a.encode_special_tokens = True     # their strings are plain text here
        with open(tokenizer_a, encoding="utf-8") as file:
            if json.load(file)["pre_tokenizer"]["type"] != "ByteLevel":
                raise ValueError("the first tokenizer must be byte-level")
        byte_of = {chr(code): byte for byte, code in enumerate(CODES.tolist()) if byte}
        byte_of[chr(256)] = 0
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the space mark inside; words are not independent")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
            b"" if self.b.is_control(i) or self.b.is_unknown(i) else
            p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        of_bytes = {x: i for i, x in enumerate(self.bytes_b) if x and self.b.is_byte(i)}
        of_bytes |= {x: i for i, x in enumerate(self.bytes_b) if x and not self.b.is_byte(i)}
        self.same = np.array([of_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64)
                                    for x in (self.bytes_a, self.bytes_b))
        self.words = "<u2" if len(self.bytes_a) <= 1 << 16 else "<u4"
        self.digits = Ragged(np.uint8)
        shown = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits.add(np.frombuffer(b"".join(shown), np.uint8),
                        np.array(list(map(len, shown)), np.int64))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.counts = np.zeros((0, 4), np.int32)        # tokens of A, of B, groups, links
        self.bad = np.zeros(0, bool)
        self.exact, self.pairs, self.shown = Ragged(self.words), Ragged(np.int64), Ragged(np.uint8)

    def is_same(self, pairs: np.ndarray) -> np.ndarray:
        return self.same[pairs >> ID_BITS] == pairs & ((1 << ID_BITS) - 1)

    def vectors(self, pairs, count, best) -> tuple[np.ndarray, np.ndarray]:
        """Count, and 1 if best, of the pair of every A id with its same B id."""
        exact = self.is_same(pairs)
        counts, bests = np.zeros((2, len(self.same)), np.int64)
        counts[pairs[exact] >> ID_BITS] = count[exact]
        bests[pairs[exact] >> ID_BITS] = best[exact]
        return counts, bests

    def align(self, texts: list[bytes]) -> list[pa.Array]:
        """The columns of ``DOCS`` after the ids, for whole texts."""
        words = words_of(texts, lower=False)
        counts = words.counts()
        before = np.where(words.begin > 0, words.bytes[words.begin - 1], 32)
        before[words.first[:-1][counts > 0]] = 32
        space = np.cumsum(np.concatenate(([0], SPACE[words.bytes])))
        other = np.cumsum(np.concatenate(([0], SPACE[words.bytes] & (words.bytes != 32) &
                                          (words.bytes != 10))))
        lo, hi = words.offset[:-1], words.offset[1:] - 1
        odd = (space[hi] - space[lo] != np.maximum(counts - 1, 0)) | (other[hi] > other[lo])
        slots = self._known(words, mix(words.hash + before.astype(U64)), before)
        odd |= _sums(self.bad[slots], words.first) > 0
        numbers = np.stack([_sums(self.counts[slots, k], words.first) for k in range(4)], 1)
        parts = []
        for values in (self.exact, self.pairs, self.shown):
            flat, size = values.take(slots)
            parts.append((flat, starts_of(size)[words.first]))
        wholes = {i: self._whole(texts[i]) for i in np.flatnonzero(odd)}
        exact, digests, owners, links = [], [], [], []
        for i in range(len(texts)):
            if i in wholes:
                numbers[i], own, pairs, shown = wholes[i]
            else:
                own, pairs, shown = (flat[first[i]:first[i + 1]] for flat, first in parts)
            exact.append(own.tobytes())
            digests.append(hashlib.sha256(shown[:-1]).hexdigest() if len(shown) else "")
            owners.append(len(pairs))
            links.append(pairs)
        owner = np.repeat(np.arange(len(texts)), owners)
        cells, times = np.unique(owner << 42 | np.concatenate([*links, np.zeros(0, np.int64)]),
                                 return_counts=True)
        first = np.searchsorted(cells >> 42, np.arange(len(texts) + 1))
        return [*(pa.array(numbers[:, k], pa.int64()) for k in range(4)),
                pa.array(digests, pa.string()), pa.array(exact, pa.binary()),
                _lists(cells & ((1 << 42) - 1), first), _lists(times, first)]

    def _known(self, words, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The slot of every word, new ones aligned."""
        if len(self.keys) > KEPT_WORDS:
            self._forget()
        found, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == found[known]
        if not known.all():
            new, used = np.flatnonzero(~known), len(self.bad)
            units = [chr(gap) + words.bytes[a:b].tobytes().decode() for gap, a, b in zip(
                before[where[new]].tolist(), words.begin[where[new]], words.end[where[new]])]
            self._learn(units)
            self.keys = np.insert(self.keys, at[new], found[new])
            self.slots = np.insert(self.slots, at[new], used + np.arange(len(new)))
            at = np.searchsorted(self.keys, found)
        return self.slots[at][inverse] if len(found) else np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        """Align new words, each with the white space before it, in lines of many."""
        usual = [i for i, u in enumerate(units) if (u[1:].isascii() and u[1:].isprintable()) or
                 UNUSUAL.isdisjoint(u[1:])]
        lines = [usual[i:i + LINE_WORDS] for i in range(0, len(usual), LINE_WORDS)]
        ids_a, ids_b, order, failed = [], [], [], []
        for line, a, b in self._encoded(units, lines):
            if a is None:
                failed += line
            else:
                ids_a += a
                ids_b += b
                order += line
        for line, a, b in self._encoded(units, [[i] for i in failed]):
            if a is not None:
                ids_a += a
                ids_b += b
                order += line
        bad = np.ones(len(units), bool)
        bad[order] = False
        sizes = np.array([len(units[i].encode()) for i in order], np.int64)
        numbers, parts = self._grouped(np.array(ids_a, np.int64), np.array(ids_b, np.int64),
                                       np.cumsum(sizes))
        place = np.zeros(len(units), np.int64)
        place[order] = np.arange(len(order))
        counts = np.zeros((len(units), 4), np.int32)
        counts[order] = numbers
        self.counts, self.bad = np.concatenate((self.counts, counts)), np.append(self.bad, bad)
        for into, (flat, size) in zip((self.exact, self.pairs, self.shown), parts):
            size_of = np.zeros(len(units), np.int64)
            size_of[order] = size
            start = starts_of(size)[:-1]
            begins = np.zeros(len(units), np.int64)
            begins[order] = start
            into.add(flat[ragged(begins, size_of)], size_of)

    def _encoded(self, units: list[str], lines: list[list[int]]):
        """Lines with the ids of both sides; no ids if these do not keep words apart."""
        first = " a"                            # a first word, so that no line begins at a gap
        texts = [first + "".join(units[i] for i in line) for line in lines]
        all_a = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        all_b = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        head_a, head_b = self.a.encode(first, add_special_tokens=False).ids, self.b.encode(first[1:])
        for line, text, a, b in zip(lines, texts, all_a, all_b):
            ends = np.cumsum([2, *(len(units[i].encode()) for i in line)])
            good = self._spell(a, b, text.encode()) and a[:len(head_a)] == head_a and \
                b[:len(head_b)] == head_b and \
                np.isin(ends, np.cumsum(self.size_a[a])).all() and \
                np.isin(ends, np.cumsum(self.size_b[b])).all()
            yield (line, a[len(head_a):], b[len(head_b):]) if good else (line, None, None)

    def _spell(self, a: list[int], b: list[int], text: bytes) -> bool:
        return b"".join([self.bytes_a[i] for i in a]) == text and \
            b"".join([self.bytes_b[i] for i in b]) == text

    def _whole(self, text: bytes):
        """Numbers, exact ids, pairs and shown groups of one text."""
        shown = text.decode()
        a = self.a.encode(" " + shown, add_special_tokens=False).ids
        b = self.b.encode(shown, num_threads=1)
        if not text or not self._spell(a, b, b" " + text):
            a = b = []
        numbers, parts = self._grouped(np.array(a, np.int64), np.array(b, np.int64),
                                       np.array([len(text) + 1 if a else 0]))
        return numbers[0], *(flat for flat, _ in parts)

    def _grouped(self, a: np.ndarray, b: np.ndarray, unit_ends: np.ndarray):
        """Numbers of each unit, and its exact ids, pairs and shown groups as ragged arrays.

        Both id sequences spell the same bytes; a unit ends where tokens of both end.
        """
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts = np.union1d(ends_a, ends_b)       # a link is a stretch between two cuts
        of_a, of_b, of_cut = (np.searchsorted(ends, x) for x in (ends_a, ends_b, cuts))
        first_a, first_b = (starts_of(np.bincount(x, minlength=len(ends))) for x in (of_a, of_b))
        single = (np.diff(first_a) == 1) & (np.diff(first_b) == 1)
        exact = single.copy()
        exact[single] = self.same[a[first_a[:-1][single]]] == b[first_b[:-1][single]]
        links = ~exact[of_cut]
        pairs = a[np.searchsorted(ends_a, cuts[links])] << ID_BITS | \
            b[np.searchsorted(ends_b, cuts[links])]
        # a token is shown as its digits and a mark; those of A stand before B's of a group
        n = len(a) + len(b)
        tokens, marks = np.zeros(n, np.int64), np.zeros(n, np.uint8)
        at_a, at_b = np.arange(len(a)) + first_b[of_a], np.arange(len(b)) + first_a[of_b + 1]
        tokens[at_a], tokens[at_b] = a, b
        last_a, last_b = (np.diff(x, append=len(ends)) > 0 for x in (of_a, of_b))
        marks[at_a], marks[at_b] = np.where(last_a, 124, 44), np.where(last_b, 59, 44)
        digits, width = self.digits.take(tokens)
        text = np.zeros(len(digits) + n, np.uint8)
        begin = starts_of(width + 1)
        text[ragged(begin[:-1], width)] = digits
        text[begin[1:] - 1] = marks
        # sums by unit: every count is cut at the units' ends
        group = np.concatenate(([0], np.searchsorted(ends, unit_ends) + 1))
        group[1:][unit_ends == 0] = 0
        cut = np.concatenate(([0], np.searchsorted(cuts, unit_ends, side="right")))
        upto_a, upto_b = first_a[group], first_b[group]
        numbers = np.stack([np.diff(x) for x in (upto_a, upto_b, group, cut)], 1)
        shown = begin[upto_a + upto_b]
        return numbers, [
            (a[first_a[:-1][exact]].astype(self.words), np.diff(starts_of(exact)[group])),
            (pairs, np.diff(starts_of(links)[cut])),
            (text, np.diff(shown))]

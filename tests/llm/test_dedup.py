"""Near, exact and passage duplicates against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from merchlight.llm import near_dedup, passages, suffix_dedup
from merchlight.llm.common import pieces, put
from merchlight.llm.components import connected_components
from tests import compare
from tests.llm.conftest import PASSAGE, ROWS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, size, percent):
    """Smallest linked id of every row, rows of one id tied together."""
    sets = [shingles(r[1], size) for r in rows]
    label = [r[0] for r in rows]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if None in (label[i], label[j]) or not a or not b:
                    continue
                if rows[i][0] == rows[j][0] or 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(r[0], len(s), lab, lab is None or lab == r[0])
            for r, s, lab in zip(rows, sets, label)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_of_odd_rows(spark, odd_docs, size):
    got = near_dedup.near_duplicates(odd_docs, shingle=size).collect()
    want = brute_components(ROWS, size, 80)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_near_duplicates_of_chains_and_hubs(spark):
    base = prose(200, 50).split()
    rows = []
    for k in range(60):                      # copies of one text with other words changed
        own = list(base)
        for at in random.Random(k).sample(range(200), k % 12):
            own[at] = f"w{k}x{at}"
        rows.append((k, " ".join(own)))
    for k in range(20):                      # a chain: each differs a little from the last
        rows.append((100 + k, " ".join(base[k * 6:] + [f"c{i}" for i in range(k * 6)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {r[0]: r[2] for r in brute_components(rows, 5, 80)}


def variants(n, place):
    """An original at a place among n copies, each 82 % to it and 68 % to each other."""
    base, rows = prose(200, 60).split(), []
    for k in range(n):
        own, draw = list(base), random.Random(k)
        for at in (10, 60, 110, 160):
            own[at + draw.randrange(30)] = f"v{k}x{at}"
        rows.append(" ".join(own))
    rows.insert(place, " ".join(base))
    return list(enumerate(rows))


@pytest.mark.parametrize("n, place, parts", [(40, 20, 4), (40, 40, 4), (1000, 500, 2),
                                             (1000, 1000, 64)])
def test_copies_of_an_original_that_is_not_the_first(spark, n, place, parts):
    docs = spark.createDataFrame(variants(n, place), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [r["component_id"] for r in near_dedup.near_duplicates(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(got) == {0: n + 1}


def crowd(pairs):
    """Sets that share a template, and of each set a copy that is 81 % to it."""
    base, rows = prose(300, 61).split(), []
    for k in range(pairs):
        own = base[:170] + prose(130, 5000 + k).split()
        near, draw = list(own), random.Random(k)
        for at in (180, 210, 240, 260, 280, 295):
            near[at + draw.randrange(5)] = f"n{k}x{at}"
        rows += [" ".join(own), " ".join(near)]
    random.Random(1).shuffle(rows)
    return list(enumerate(rows))


def test_crowded_regions_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows, trees, depth, least = crowd(60), 3, 8, 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_dedup._signatures(docs, 5, trees * depth).collect()
    paths = {r["doc_id"]: {(t, bytes(r["signature"][32 * t:32 * t + 4 * least]))
                           for t in range(trees)} for r in signed}
    sets = {i: shingles(text, 5) for i, text in rows}
    pairs = [(i, j) for i in sets for j in sets if i < j and paths[i] & paths[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(pairs) > 40
    got = near_dedup.near_duplicates(docs, trees=trees, depth=depth, least=least, crowded=4)
    parts = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert [p for p in pairs if parts[p[0]] != parts[p[1]]] == []


def test_rows_do_not_grow_with_the_pairs_of_a_crowd(spark, monkeypatch):
    """Sets that are 68 % to each other agree in signatures and are linked with nothing."""
    rows = [(k, text) for k, text in variants(120, 120)[:120]]
    made, put = {}, near_dedup.put

    def counted(df, label):
        out = put(df, label)
        if label.startswith("rest"):           # what settles the regions
            made[label] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "put", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, trees=6, least=2, crowded=4)
    sets = [shingles(text, 5) for _, text in rows]
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert sorted(r["component_id"] for r in got.collect()) == list(range(120))
    assert made and max(made.values()) <= 6 * 120


def test_staged_tables_go_when_nothing_reads_them(spark, monkeypatch):
    rows = [(k, text) for k, text in variants(60, 40)[:60]]
    made, plans, put = {}, [], near_dedup.put

    def kept(df, label):
        out = put(df, label)
        made.setdefault(label, []).append(out.staged_at.removeprefix("file:"))
        if label == "regions":                 # scores need no join of the sets with themselves
            plans.append(df._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(near_dedup, "put", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, trees=6, least=2, crowded=4)
    for label in ("signed", "candidates", "region-sets", "regions", "pairs", "rest", "rest-sets"):
        assert made[label] and not any(map(os.path.exists, made[label])), label
    assert all(os.path.exists(path) for path in made["sets"])
    assert len(plans) == 1 and "Join" not in plans[0]
    assert got.count() == 60


def test_near_duplicates_equal_sql(spark, tables):
    name = "op1_minhash_near_dedup"
    df = driver.queries()[name](spark, tables)
    assert compare.differences(df, compare.connect(tables), driver.oracle_sql()[name]) == []


def test_keep_one(spark, odd_docs):
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[6] == 1 and ids[7] == ids[8] == 0 and ids[1] == 1 and ids[None] == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7),
             (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_bytes(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + width] for x in data for i in range(len(x) - width + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if seen[x[i:i + width]] > 1:
                gone[i:i + width] = True
        edges = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def removed(df):
    return sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in df.collect())


def test_repeated_bytes_of_odd_rows(spark, odd_docs):
    want = [(-1 if r[0] is None else r[0], *x)
            for r, x in zip(ROWS, brute_bytes([r[1] for r in ROWS], 200))]
    assert removed(suffix_dedup.repeated_bytes(odd_docs)) == sorted(want)


@pytest.mark.parametrize("letters", ["ab", "abcdé\n", "a"])
def test_repeated_bytes_of_repetitive_texts(spark, letters):
    draw = random.Random(3)
    bits = ["".join(draw.choice(letters) for _ in range(draw.randint(20, 90))) for _ in range(12)]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 8))) for _ in range(80)]
    texts += ["a" * 500, "b" * 41, "z" * 40 + "a" * 100, "\0" * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *x) for i, x in enumerate(brute_bytes(texts, 40)))
    assert removed(suffix_dedup.repeated_bytes(docs, width=40)) == want


def test_lanes_meet_across_tasks():
    """Strings of one anchor that lie in several lanes leave a digest for each lane."""
    pieces = [prose(30, k).encode()[:60] for k in range(3)]
    held = [(b"x", 0, pieces[0], True), (b"y", 5, pieces[1], True), (b"z", 9, pieces[0], True)]
    found = [b.to_pylist() for b in suffix_dedup._block(held, 40)]
    assert {r["t"] for r in found[0]} == {b"x", b"z"}
    digests = [r["digest"] for r in found[1]]
    assert len(set(digests)) == len(digests) == 2 * 21


def test_suffix_order_is_the_order_of_the_strings():
    draw = random.Random(8)
    data = [bytes(draw.choice(b"abc") for _ in range(draw.randint(20, 120))) for _ in range(30)]
    order, equal, text, begin, owned = suffix_dedup.suffix_order(data, 20)
    raw = text.tobytes()
    strings = [raw[p:p + 20] for p in order.tolist()]
    assert len(order) == int(owned.sum()) and strings == sorted(strings)
    assert equal.tolist() == [a == b for a, b in zip(strings, strings[1:])]


def test_compact_windows_are_the_runs_of_their_minimum():
    draw = np.random.default_rng(5)
    values = draw.integers(0, 2**62, 300).astype(np.uint64)
    first, salt = np.array([0, 120, 125, 300]), np.uint64(77)
    owner, left, low, right = passages.compact_windows(values, first, salt, 10)
    hashed = passages.mix(values ^ salt)
    covered = set()
    for o, a, c, b in zip(owner, left, low, right):
        assert first[o] <= a <= c <= b < first[o + 1] and b - a + 1 >= 10
        assert hashed[c] == hashed[a:b + 1].min()
        covered |= {(i, j) for i in range(a, c + 1) for j in range(c, b + 1) if j - i >= 9}
    want = sum(max(0, n - 9) * max(0, n - 8) // 2 for n in np.diff(first))
    assert len(covered) == want          # every run of 10 or more in exactly one window


def test_passages(spark, odd_docs):
    spans = passages.repeated_passages(odd_docs)
    cut = passages.remaining(odd_docs, spans)
    assert cut.columns[:len(odd_docs.columns)] == odd_docs.columns
    rows = {}
    for r in cut.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert [r["_n_removed"] for r in rows[6]] == [0]
    assert [r["_n_removed"] for r in rows[7]] == [120, 120]      # copies of 6
    assert rows[8][0]["_kept"].split() == ["tail", "end"]
    assert rows[9][0]["_n_removed"] == 0                         # the first occurrence
    kept = rows[10][0]["_kept"]
    assert PASSAGE not in kept and kept == prose(70, 4) + " " + prose(50, 5)
    assert rows[11][0]["_n_words"] - rows[11][0]["_n_removed"] < 3
    assert [r["_kept"] for r in rows[1]] == [None] and rows[2][0]["_kept"] == ""
    assert all(r["_n_removed"] == 0 for i in (3, 4, 5, 13, 15, 16, 17, None) for r in rows[i])


def test_near_passages_go_and_others_stay(spark):
    rows, changed = [(0, prose(100, 70) + " " + PASSAGE)], PASSAGE.split()
    changed[40] = "other"
    rows.append((1, prose(90, 71) + " " + " ".join(changed) + " " + prose(30, 72)))
    half = PASSAGE.split()
    half[::4] = [f"n{i}" for i in range(len(half[::4]))]         # too many changes
    rows.append((2, prose(90, 73) + " " + " ".join(half)))
    rows.append((3, prose(90, 74) + " " + " ".join(PASSAGE.split()[:40])))   # too short
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r for r in passages.remaining(
        docs, passages.repeated_passages(docs)).collect()}
    assert cut[1]["_n_removed"] in range(78, 84)
    assert [cut[i]["_n_removed"] for i in (0, 2, 3)] == [0, 0, 0]


def test_passages_whose_values_meet_other_texts_first(spark):
    """Earlier texts hold each shingle of the passage, but none of them the passage."""
    words, rows = PASSAGE.split(), []
    for _ in range(4):
        for i in range(len(words) - 4):
            at = len(rows)
            rows.append((at, prose(60, 50_000 + at) + " " + " ".join(words[i:i + 5]) + " " +
                         prose(60, 60_000 + at)))
    for k in range(6):
        rows.append((1000 + k, prose(60, 70_000 + k) + " " + PASSAGE + " " + prose(60, 80_000 + k)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r["_n_removed"] for r in passages.remaining(
        docs, passages.repeated_passages(docs)).collect()}
    assert {i for i, n in cut.items() if n} == set(range(1001, 1006))
    assert all(cut[i] in range(78, 84) for i in range(1001, 1006))


def test_rows_do_not_grow_with_the_pairs_that_share_a_line(spark, monkeypatch):
    """A line just too short for a passage pairs all texts; each comes once to its cell."""
    line, n = " ".join(PASSAGE.split()[:40]), 60
    rows = [(k, prose(20, 90_000 + k) + " " + line + " " + prose(20, 91_000 + k)) for k in range(n)]
    rows.append((n, prose(30, 92_000) + " " + rows[n - 1][1]))       # a real repeat
    rows.append((n + 1, rows[0][1] + " " + prose(30, 92_001) + " " + PASSAGE + " " + PASSAGE))
    made, put = {}, passages.put

    def counted(df, label):
        out = put(df, label)
        made.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(passages, "put", counted)
    monkeypatch.setattr(passages, "discard", lambda *staged: None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r["_n_removed"] for r in passages.remaining(
        docs, passages.repeated_passages(docs)).collect()}
    assert {i for i, gone in cut.items() if gone} == {n, n + 1}
    assert cut[n] in range(78, 82) and cut[n + 1] >= 156
    pairs = [df.count() for label in ("laned", "window-pairs") for df in made.get(label, [])]
    verified = [df.count() for label in ("laned", "cells") for df in made.get(label, [])]
    assert max(pairs) > 10 * n                   # all pairs are there
    assert verified and max(verified) <= 4 * n


def test_texts_that_share_a_line_alone_do_not_meet(spark, monkeypatch):
    """Pairs of a frequent line go before they are rows; those of a passage around it stay."""
    line, n, rows = " ".join(PASSAGE.split()[:30]), 90, []
    for k in range(n):
        rows.append((k, prose(40, 95_000 + k) + " " + line + " " + prose(40, 96_000 + k)))
    changed = rows[40][1].split()
    changed[::40] = [f"w{i}" for i in range(len(changed[::40]))]
    rows.append((n, prose(30, 97_000) + " " + " ".join(changed)))            # near one of them
    rows.append((n + 1, rows[55][1] + " " + rows[55][1]))                    # the same twice
    other = prose(40, 98_000)
    for k in range(20):                          # many texts around a passage with a changing end
        rows.append((200 + k, prose(30, 98_100 + k) + " " + line + " " + other[:200 + 2 * k] + " " +
                     prose(20, 98_200 + k)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    put, seen = passages.put, []
    for crowd in (8, 1 << 30):                   # above it no key is crowded
        made = {}

        def kept(df, label, made=made):
            made[label] = put(df, label)
            return made[label]

        monkeypatch.setattr(passages, "put", kept)
        monkeypatch.setattr(passages, "discard", lambda *staged: None)
        monkeypatch.setattr(passages, "CROWD", crowd, raising=False)
        monkeypatch.setattr(passages, "COMMON", 8, raising=False)
        spans = sorted((r["doc_id"], str(r["spans"])) for r in passages.repeated_passages(docs).collect())
        seen.append((spans, made["window-pairs"].count()))
    assert seen[0][0] == seen[1][0] and {n, n + 1} <= {i for i, _ in seen[0][0]}
    assert 2 * seen[0][1] < n * n // 2 < seen[1][1]


def test_a_passage_of_common_shingles_is_told_from_a_line():
    draw = np.random.default_rng(6)
    for _ in range(200):
        n = int(draw.integers(1, 120))
        places = np.flatnonzero(draw.random(n) < draw.choice([.3, .7, .8, .9]))
        other = np.ones(n, int)
        other[places] = 0
        brute = any(100 * other[x:y].sum() <= 20 * (y - x) for x in range(n) for y in range(x + 46, n + 1))
        assert passages.is_common(places, n, 46, 80) == brute


def test_shuffle_files_of_a_staged_table_go(spark, tmp_path):
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []

    class Watched:                               # what the option is while the table is written
        def __init__(self, df):
            self.df, self.sparkSession, self.schema = df, df.sparkSession, df.schema

        @property
        def write(self):
            seen.append(spark.conf.get(name))
            return self.df.write

    before = spark.conf.get(name)
    out = put(Watched(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()), "cleaned")
    assert out.count() == 7 and seen == ["true"] and spark.conf.get(name) == before


def test_empty_tables(spark, no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0
    assert passages.remaining(no_docs, passages.repeated_passages(no_docs)).count() == 0


def test_hot_passages_go_whatever_the_number_of_partitions(spark):
    rows = [(k, prose(9, 10000 + k) + " " + (PASSAGE if k % 3 == 0 else prose(20, 20000 + k)) +
             " " + prose(9, 30000 + k)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (2, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spans = passages.repeated_passages(docs).collect()
            seen.append(sorted((r["doc_id"], [tuple(x) for x in r["spans"]]) for r in spans))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    assert {i for i, _ in seen[2]} == set(range(3, 4000, 3))


def test_one_lookup_gives_the_spans_of_one_for_each_box(monkeypatch):
    draw = np.random.default_rng(4)
    for _ in range(30):
        a = draw.permutation(400).astype(np.uint64)
        b = np.concatenate((draw.integers(1000, 2000, 60), a[50:150], draw.integers(1000, 2000, 9),
                            a[160:260], draw.integers(1000, 2000, 40))).astype(np.uint64)
        b[draw.integers(0, len(b), 6)] = 5000
        boxes = np.array([[lo, lo + 180, x, x + 200] for lo, x in
                          zip(draw.integers(0, 200, 8), draw.integers(0, 100, 8))])
        fast = passages.matching_spans(a, b, boxes, 46, 80, False)
        # an equal pair of shingles at the end, outside all boxes, forbids the one lookup
        slow = passages.matching_spans(np.append(a, [9999, 9999]).astype(np.uint64), b, boxes,
                                       46, 80, False)
        assert fast == slow


def longest_by_brute_force(a, b, least, percent):
    """The longest span of b, of shared ends, that is similar enough to some span of a."""
    met = np.zeros((len(a) + 1, len(b) + 1), int)
    met[1:, 1:] = (a[:, None] == b[None, :]).cumsum(0).cumsum(1)
    p, q = np.triu_indices(len(a))
    for n in range(len(b), least - 1, -1):
        for x in np.flatnonzero(np.isin(b[:len(b) - n + 1], a) & np.isin(b[n - 1:], a)):
            shared = met[q + 1, x + n] - met[p, x + n] - met[q + 1, x] + met[p, x]
            if (100 * shared >= percent * (q - p + 1 + n - shared)).any():
                return n
    return 0


@pytest.mark.parametrize("inserted", range(1, 16))
def test_spans_reach_over_insertions(inserted):
    draw = np.random.default_rng(inserted)
    a = draw.permutation(76).astype(np.uint64)                 # 80 words
    new = draw.integers(1000, 10**9, 4 + inserted).astype(np.uint64)
    b = np.concatenate((draw.integers(1000, 10**9, 30).astype(np.uint64), a[:36], new, a[40:],
                        draw.integers(1000, 10**9, 30).astype(np.uint64)))
    boxes = np.array([[0, len(a) - 1, 0, len(b) - 1]])
    found = passages.matching_spans(a, b, boxes, 46, 80, False)
    assert max((y - x + 1 for x, y in found), default=0) == longest_by_brute_force(a, b, 46, 80)
    assert bool(found) == (inserted <= 10)


def test_ranges_follow_the_order_of_values_and_documents():
    rng = np.random.default_rng(3)
    values, docs = rng.integers(-4, 5, 3000), rng.integers(-50, 50, 3000)
    values[::3] = 1                                # a hot value
    cuts = passages.bounds(values, docs, 30)
    part = passages.ranges(values, docs, *cuts)
    order = np.lexsort((docs, values))
    assert (np.diff(part[order]) >= 0).all() and part.min() == 0 and part.max() == 29
    assert np.bincount(part).max() < 300
    assert len(set(zip(values, docs, part))) == len(set(zip(values, docs)))
    few = passages.bounds(values[:5], docs[:5], 4)
    assert few[0].tolist() == [-2**62, 0, 2**62]


def test_batches_come_in_pieces_of_few_rows():
    batch = pa.record_batch([pa.array(range(1000)), pa.array([[i] * (i % 3) for i in range(1000)])],
                            names=["a", "b"])
    made = list(pieces(iter([batch, batch.slice(0, 0), batch])))
    assert max(x.num_rows for x in made) <= 256
    assert pa.Table.from_batches(made).equals(pa.Table.from_batches([batch, batch]))


def test_verification_is_the_same_whatever_a_batch_holds(spark, monkeypatch):
    """Members of a cell's rows are read from pieces of an Arrow batch, one row or all of them."""
    rows = [(k, prose(30, 3 * k) + " " + PASSAGE + " " + prose(30, 3 * k + 1)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = []
    for size in (1, 7, 10_000):
        monkeypatch.setattr(passages, "pieces", lambda batches, size=size: pieces(batches, size))
        found.append(sorted((r["doc_id"], r["text_hash"], str(r["spans"]))
                            for r in passages.repeated_passages(docs).collect()))
    assert [r[0] for r in found[0]] == list(range(1, 40)) and found[0] == found[1] == found[2]

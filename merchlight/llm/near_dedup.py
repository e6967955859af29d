"""Near-duplicate documents by a MinHash LSH forest.

Every distinct shingle set gets ``trees * depth`` minimum hashes. Each tree is one
sorted order of the sets by its ``depth`` hashes (a range-partitioned sort, so a
crowded region spreads over tasks). Sets whose prefixes agree on at least ``least``
hashes form a region, counted over all tasks; a region with more than ``crowded`` sets
also gives regions one level deeper, and so on. Candidates are each set with its
neighbour in the order and with the leader of each of its regions, the set whose regions
in all trees are largest. Their number is linear in sets and trees. Candidates are
confirmed on full shingle sets, in rounds: first each set with its most frequent partner,
then what the components found so far leave open. Last come, of every region of ``least``
hashes, however crowded, all pairs in different components, in blocks; where whole
signatures agree nearly as often as those of similar sets do, the full sets are compared
in the block itself, which gives links that connect what it holds and no row for each pair.
No candidate is left unconfirmed unless both its ends are linked.

A pair of similarity s meets in a region of a tree with probability s**least, so at
0.8 all of 20 trees miss it with probability 3e-5, crowded or not; the signatures of such
a pair agree too seldom with probability 1e-6 (``SPREAD`` deviations).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from merchlight.llm.common import discard, keyed_text, put, slices, utf8
from merchlight.llm.components import connected_components
from merchlight.llm.words import U64, distinct_per_text, mix, shingles_of, words_of

TREES, DEPTH, LEAST, CROWDED = 20, 8, 4, 64
#: Members compared with one copy of a leader's text in one group of rows.
MEMBERS = 200
#: Sets of a region, and their shingles, that a task holds beside as many others.
BLOCK, HELD = 4096, 1 << 21
#: Deviations below its mean at which the agreement of two signatures is too low.
SPREAD = 5


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    shingle: int = 5, percent: int = 80, trees: int = TREES,
                    depth: int = DEPTH, least: int = LEAST,
                    crowded: int = CROWDED) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of other bytes than white space, A-Z lower-cased; a document's set
    is that of its distinct ``shingle``-word runs, or the whole sequence if it is
    shorter. Two documents are linked if their sets' intersection is at least
    ``percent`` % of the union; ``component_id`` is the smallest id linked directly
    or through others, ``kept`` whether the document is that one.

    Null and empty texts and texts without words have no shingles and are linked with
    nothing. A row without id has a null component and is kept. Rows that share an id
    are one node with the links of all their texts. Other columns are ignored; an
    empty table gives an empty result.
    """
    signed = put(_signatures(keyed_text(docs, id_col, text_col), shingle, trees * depth), "signed")
    some, key = "n_shingles > 0 AND doc_id IS NOT NULL", ["h1", "h2", "n_shingles"]
    classes = put(signed.where(some).groupBy(*key).agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "classes")
    sets = put(signed.drop("signature"), "sets")        # only the classes' are needed from here
    discard(signed)
    linked = sets.where(some)
    forest = _forest(classes, trees, depth)
    regions = _regions(forest, depth, least, crowded)
    near = put(_neighbours(forest, depth, least), "candidates")
    found = _across_tasks(near, _led(regions), least)
    discard(near)

    texts = keyed_text(docs, id_col, text_col)
    links = _in_rounds(found, lambda pairs: _confirmed(pairs, classes, texts, shingle, percent))
    # rows that share an id tie their sets together
    same_id = linked.join(classes.select(*key, "node"), key) \
        .where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    ids_twice = linked.select("doc_id", *key).distinct().groupBy("doc_id").count() \
        .where("count > 1").select(F.col("doc_id").alias("a"))
    links = _settled(regions, classes, links, texts, shingle, percent, depth, least)
    discard(regions, found)
    edges = links.union(same_id.join(ids_twice, "a"))
    parts = put(connected_components(edges), "parts")
    named = put(classes.join(parts.toDF("node", "component"), "node", "left").select(
        *key, F.coalesce("component", "node").alias("component")), "named")
    discard(classes, parts)
    return sets.select("doc_id", *key).join(named, key, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
        .alias("component_id")).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
        .alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _in_rounds(found: DataFrame, confirm) -> DataFrame:
    """The links of the candidates ``a, b, votes``, best partners first."""
    best = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes")) \
        .groupBy("a").agg(F.max(F.struct("votes", (-F.col("b")).alias("b"))).alias("x")) \
        .select(F.greatest("a", -F.col("x.b")).alias("b"), F.least("a", -F.col("x.b")).alias("a")) \
        .distinct()
    links = put(confirm(best), "links")
    parts = put(connected_components(links), "parts")
    open_ = found.join(best, ["a", "b"], "left_anti") \
        .join(parts.toDF("a", "ca"), "a", "left").join(parts.toDF("b", "cb"), "b", "left") \
        .where("NOT coalesce(ca, a) <=> coalesce(cb, b)").select("a", "b")
    return links.union(put(confirm(put(open_, "open")), "links"))


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    kept, first = shingles_of(words_of(texts, lower=True), shingle, short=True)
    return distinct_per_text(kept, first)


def set_sums(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that tell sets apart, whatever the order of their values."""
    out = []
    for salt in (0x165667B19E3779F9, 0x27D4EB2F165667C5):
        run = np.concatenate((np.zeros(1, U64), np.cumsum(mix(values ^ U64(salt)), dtype=U64)))
        out.append((run[first[1:]] - run[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _signatures(docs: DataFrame, shingle: int, width: int) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, signature``; big-endian, so that bytes sort alike."""
    draw = np.random.default_rng(7)
    flips = draw.integers(0, 2**32, width, dtype=np.uint32)
    factors = draw.integers(0, 2**31, width, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for lo, hi in slices(texts):
                values, first = shingle_sets(texts[lo:hi], shingle)
                some = np.flatnonzero(np.diff(first))
                out = np.zeros((hi - lo, width), ">u4")
                if len(some):
                    low = (values >> U64(20)).astype(np.uint32)
                    for k in range(width):
                        out[some, k] = np.minimum.reduceat((low ^ flips[k]) * factors[k],
                                                           first[some])
                h1, h2 = set_sums(values, first)
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(h1), pa.array(h2),
                     pa.array([r.tobytes() for r in out], pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "signature"])

    return docs.mapInArrow(
        signed, "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def _forest(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """``node, n_shingles, tree, path``: each set's hashes in every tree."""
    width = 4 * depth
    return classes.select("node", "n_shingles", F.explode(F.expr(
        f"transform(sequence(0, {trees - 1}), t -> struct(t AS tree, "
        f"substring(signature, t * {width} + 1, {width}) AS path))")).alias("x")) \
        .select("node", "n_shingles", "x.tree", "x.path")


def _neighbours(forest: DataFrame, depth: int, least: int) -> DataFrame:
    """``a, b`` of neighbours, and the first and last row of every task's share."""
    parts = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = forest.select("tree", "path", "node").repartitionByRange(
        parts, "tree", "path", "node").sortWithinPartitions("tree", "path", "node")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, seen, last = TaskContext.get().partitionId(), False, None
        held = None                       # the last row so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (np.asarray(batch.column(0)), _paths(batch.column(1), depth),
                    np.asarray(batch.column(2)))
            if not seen:
                yield _edge(task, 0, batch, 0)
                seen = True
            last = batch.slice(batch.num_rows - 1)
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows))
            held = tuple(x[-1:] for x in rows)
            tree, path, node = rows
            near = np.flatnonzero(_common(tree, path) >= least)
            both = np.sort(np.stack((node[near - 1], node[near]), axis=1), axis=1)
            if len(both):
                both, votes = np.unique(both, axis=0, return_counts=True)
                yield _batch(both[:, 0], both[:, 1], votes)
        if last is not None:
            yield _edge(task, 1, last, 0)

    return order.mapInArrow(
        walk, "a long, b long, votes long, task int, side int, tree int, path binary")


def _regions(forest: DataFrame, depth: int, least: int, crowded: int) -> DataFrame:
    """``region, tree, node, n_shingles, score, outer`` of sets that share a prefix.

    Regions are counted over the whole table, whatever task holds which rows. A crowded
    one stays, and its sets also form regions one level deeper; the outer ones hold all
    pairs of the others. The score of a set adds up the sizes of its regions in all
    trees: what agrees with most others leads.
    """
    rows, levels, staged = forest, [], []
    for d in range(least, depth + 1):
        keyed = rows.select("node", "n_shingles", "tree", "path", F.xxhash64(
            F.lit(d), "tree", F.substring("path", 1, 4 * d)).alias("region"))
        # two sets are neighbours
        sizes = keyed.groupBy("region").agg(F.count("*").alias("size")).where("size > 2")
        held = put(keyed.join(sizes, "region"), "region-sets")
        staged.append(held)
        wide = held.where(F.col("size") > crowded)
        deeper = d < depth and not wide.isEmpty()
        levels.append(held.select("region", "tree", "node", "n_shingles", "size",
                                  F.lit(d == least).alias("outer")))
        if not deeper:
            break
        rows = wide.select("node", "n_shingles", "tree", "path")
    # a set is in one region of each tree and level at most
    regions = put(reduce(DataFrame.union, levels).select(
        "region", "tree", "node", "n_shingles",
        F.sum("size").over(Window.partitionBy("node")).alias("score"), "outer"), "regions")
    discard(*staged)
    return regions


def _led(regions: DataFrame) -> DataFrame:
    """``a, b, votes`` of each set with the leader of its region."""
    leaders = regions.groupBy("region").agg(
        F.max(F.struct("score", (-F.col("node")).alias("n"))).alias("x")) \
        .select("region", (-F.col("x.n")).alias("leader"))
    return regions.join(leaders, "region").where("node <> leader").select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"),
        F.lit(1).cast("long").alias("votes"))


#: What a task compares: the region and its two blocks, and of each set what it needs.
SETTLED = ("region long, low int, high int, tree int, block int, node long, c long, "
           "n_shingles long, signature binary")


def _settled(regions: DataFrame, classes: DataFrame, links: DataFrame, texts: DataFrame,
             shingle: int, percent: int, depth: int, least: int) -> DataFrame:
    """``links`` and those inside regions that the leaders and neighbours did not find.

    In a region of several components all pairs of two components are compared by their
    signatures, in blocks of bounded size; the sets of those that agree well enough come
    again with their texts and are compared as full sets.
    """
    parts = put(connected_components(links), "parts")
    named = put(regions.where("outer").select("region", "tree", "node", "n_shingles")
                .join(parts.toDF("node", "component"), "node", "left").select(
        "region", "tree", "node", "n_shingles", F.coalesce("component", "node").alias("c")), "rest")
    order = Window.partitionBy("region").orderBy("c", "node")   # blocks of few components
    weight = F.greatest(F.lit(HELD // BLOCK).cast("long"), F.col("n_shingles"))
    mixed = named.groupBy("region").agg(F.min("c").alias("x"), F.max("c").alias("y")) \
        .where("x <> y").select("region")
    placed = named.join(mixed, "region").withColumn(
        "block", F.floor((F.sum(weight).over(order) - weight) / HELD).cast("int"))
    blocks = placed.groupBy("region").agg(F.max("block").alias("last"))
    rest = placed.join(blocks, "region").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    rows = rest.join(classes.select("node", "signature"), "node").select(
        "region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "tree", "block", "node", "c", "n_shingles", "signature")

    def open_(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for group in groups:
            some = np.zeros(len(group), bool)
            for i, j in alike(group, percent, depth, least):
                some[i] = some[j] = True
            if some.any():
                yield from group.filter(pa.array(some)).to_batches()

    def compared(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for group in groups:
            node, text = group.column("node").to_numpy(), utf8(group.column("text"))
            sets = []
            for lo, hi in slices(text):
                values, first = shingle_sets(text[lo:hi], shingle)
                sets += [values[x:y].copy() for x, y in zip(first, first[1:])]
            root, out = list(range(len(sets))), []
            for i, j in alike(group, percent, depth, least):
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = _root(root, x), _root(root, y)
                    if p != q and _similar(sets[x], sets[y], percent):
                        root[q] = p
                        out.append((node[x], node[y]))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    width = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["region", "low", "high"]
    found = put(rows.repartition(width, *key).sortWithinPartitions(*key).mapInArrow(
        lambda batches: open_(_groups(batches)), SETTLED), "rest-sets")
    discard(named)
    # another text under the same id is another set
    own = classes.select("node", "h1", "h2")
    hashed = _summed(texts.join(found.select("node").distinct(), F.col("doc_id") == F.col("node"),
                                "left_semi"), shingle)
    whole = hashed.join(own, (F.col("doc_id") == F.col("node")) & (F.col("s1") == F.col("h1")) &
                        (F.col("s2") == F.col("h2"))).select("node", "text").dropDuplicates(["node"])
    more = put(found.join(whole, "node").select(*[c.split()[0] for c in SETTLED.split(", ")], "text")
               .repartition(width, *key).sortWithinPartitions(*key)
               .mapInArrow(lambda batches: compared(_groups(batches)), "a long, b long"), "rest-links")
    discard(found)
    return links.union(more)


def _summed(texts: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text, s1, s2``: the texts with the sums of their sets."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = utf8(batch.column(1))
            for lo, hi in slices(data):
                s1, s2 = set_sums(*shingle_sets(data[lo:hi], shingle))
                yield pa.record_batch(
                    [*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(s1), pa.array(s2)],
                    names=["doc_id", "text", "s1", "s2"])

    return texts.select("doc_id", "text").mapInArrow(
        summed, "doc_id long, text string, s1 long, s2 long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first three columns, by which they are sorted."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        keys = np.stack([held.column(k).to_numpy() for k in range(3)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            yield held.slice(lo, hi - lo)
        held = held.slice(cuts[-1]) if len(cuts) else held
    if held is not None:
        yield held


def _root(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def alike(group: pa.Table, percent: int, depth: int,
          least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of the pairs of two blocks, or inside one, whose signatures agree.

    A pair that an earlier tree's region holds too is left to that one.
    """
    tree, block, node, c, n = (group.column(k).to_numpy() for k in range(3, 8))
    first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    if len(np.unique(c)) == 1:
        return
    data = b"".join(group.column(8).to_pylist())
    hashes = np.ascontiguousarray(np.frombuffer(data, ">u4").reshape(len(node), -1).T).astype(np.uint32)
    width, share = len(hashes), percent / 100
    enough = width * share - SPREAD * np.sqrt(width * share * (1 - share))
    other = hashes[:, second]
    for lo in range(0, len(first), 64):
        x = first[lo:lo + 64]
        open_ = (c[x][:, None] != c[second]) & (
            100 * np.minimum(n[x][:, None], n[second]) >= percent * np.maximum(n[x][:, None], n[second]))
        if block.min() == block.max():
            open_ &= x[:, None] < second
        if not open_.any():
            continue
        votes = np.zeros(open_.shape, np.int16)
        for k in range(width):
            votes += hashes[k, x][:, None] == other[k]
        i, j = np.nonzero(open_ & (votes >= enough))
        i, j = x[i], second[j]
        for t in range(tree[0]):
            apart = (hashes[t * depth:t * depth + least, i] !=
                     hashes[t * depth:t * depth + least, j]).any(axis=0)
            i, j = i[apart], j[apart]
        if len(i):
            yield i, j


def _paths(column, depth: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, ">u4").reshape(-1, depth).astype(np.uint32)


def _common(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Hashes that each row's prefix shares with the row before; -1 at the first row."""
    out = np.full(len(tree), -1)
    same = np.logical_and.accumulate(path[1:] == path[:-1], axis=1).sum(axis=1)
    out[1:] = np.where(tree[1:] == tree[:-1], same, -1)
    return out


COLUMNS = ["a", "b", "votes", "task", "side", "tree", "path"]


def _batch(a, b, votes=None, task=None, side=None, tree=None, path=None) -> pa.RecordBatch:
    n = len(a)
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
    return pa.record_batch([pa.nulls(n, k) if x is None else pa.array(x, k)
                            for x, k in zip((a, b, votes, task, side, tree, path), kinds)],
                           names=COLUMNS)


def _edge(task: int, side: int, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
    return _batch([batch.column(2)[i].as_py()], [None], None, [task], [side],
                  [batch.column(0)[i].as_py()], [batch.column(1)[i].as_py()])


def _across_tasks(found: DataFrame, led: DataFrame, least: int) -> DataFrame:
    """The candidates with their leaders, and with neighbours that are the ends of two tasks' shares.

    The ends are two rows for each task, whatever the number of documents.
    """
    ends = found.where("task IS NOT NULL").select("task", "side", "tree", "path", "a")
    order = Window.orderBy("task", "side")
    ends = ends.select("a", "path", "tree", F.lag("a").over(order).alias("b"),
                       F.lag("path").over(order).alias("q"), F.lag("tree").over(order).alias("t"))
    ends = ends.where((F.col("tree") == F.col("t")) & (F.col("a") != F.col("b")) & (
        F.substring("path", 1, 4 * least) == F.substring("q", 1, 4 * least)))
    pairs = found.where("task IS NULL").select("a", "b", "votes").union(
        ends.select(F.least("a", "b"), F.greatest("a", "b"), F.lit(1).cast("long")))
    return put(pairs.union(led).groupBy("a", "b").agg(F.sum("votes").alias("votes")), "pairs")


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int,
               percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough.

    Pairs are grouped under the end with more of them, its text comes once for each
    ``MEMBERS`` others, and a task holds one set of the leader beside the others'.
    """
    degree = put(pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").count(),
                 "degrees")
    ranked = pairs.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    turned = ranked.select(
        F.when(F.expr("da >= db"), F.col("a")).otherwise(F.col("b")).alias("leader"),
        F.when(F.expr("da >= db"), F.col("b")).otherwise(F.col("a")).alias("member"),
        F.greatest("da", "db").alias("many"))
    turned = put(turned.withColumn("lane", F.pmod(
        F.xxhash64("member"), F.ceil(F.col("many") / MEMBERS)).cast("long")), "turned")
    own = classes.select(F.col("node").alias("id"), "h1", "h2")
    rows = turned.select("leader", "lane", F.lit(0).alias("place"), F.col("leader").alias("id")) \
        .distinct().union(turned.select("leader", "lane", F.lit(1), "member"))
    rows = rows.join(own, "id").join(texts.withColumnRenamed("doc_id", "id"), "id") \
        .select("leader", "lane", "place", "id", "h1", "h2", "text")
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "leader", "lane") \
        .sortWithinPartitions("leader", "lane", "place", "id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for batch in batches:
            leader, lane, place, ids, h1, h2 = (np.asarray(batch.column(k)) for k in range(6))
            data = utf8(batch.column(6))
            links = []
            for lo, hi in slices(data):
                values, first = shingle_sets(data[lo:hi], shingle)
                s1, s2 = set_sums(values, first)
                for i in range(lo, hi):
                    own = values[first[i - lo]:first[i - lo + 1]]
                    if s1[i - lo] != h1[i] or s2[i - lo] != h2[i]:
                        continue           # another text under the same id
                    if place[i] == 0:
                        now, head = (leader[i], lane[i]), own.copy()
                    elif now == (leader[i], lane[i]) and _similar(head, own, percent):
                        links.append((leader[i], ids[i]))
            if links:
                yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()),
                                       pa.array([y for _, y in links], pa.int64())],
                                      names=["a", "b"])

    return rows.mapInArrow(compared, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    few, many = sorted((len(x), len(y)))
    if 100 * few < percent * many:
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (few + many - shared)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its component.

    Repeated rows of a kept id all stay; rows without id stay.
    """
    parts = near_duplicates(docs, id_col, text_col, **options)
    gone = parts.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(put(gone, "gone"), id_col, "left_anti").select(*docs.columns)

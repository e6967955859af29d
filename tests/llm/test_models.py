"""Mixing, neighbours, language, quality and the pipeline."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from merchlight.llm import language, mixing, neighbours, quality
from merchlight.llm.common import documents, put, table
from tests import compare
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mixing_equals_sql(spark, tables):
    name = "op4_mixing_sources"
    df = driver.queries()[name](spark, tables)
    assert compare.differences(df, compare.connect(tables), driver.oracle_sql()[name]) == []


def test_mixing_meets_its_marginals(spark, tables):
    out = mixing.mix_sources(documents(spark, tables)).toPandas()
    out["w"] = out["_probability"] * out["_n_tokens"]
    for column, power in (("source", 0.9), ("lang", 0.9), ("_topic", 1.0)):
        want = out.groupby(column)["_n_tokens"].sum() ** power
        got = out.groupby(column)["w"].sum()
        assert np.allclose(got / got.sum(), want / want.sum(), atol=0.01)
    assert out["_probability"].max() == 1


def test_mixing_of_odd_rows(odd_docs, no_docs):
    out = mixing.mix_sources(odd_docs)
    assert out.columns[:len(odd_docs.columns)] == odd_docs.columns
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert sorted(r["_n_tokens"] for r in rows) == sorted(len(WORD.findall(r[1] or ""))
                                                          for r in ROWS)
    assert mixing.mix_sources(no_docs).count() == 0


def brute_nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        scored = [(-float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), i)
                  for i, x in rows if i != q]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_neighbours_recall(spark):
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + draw.normal(size=16) * 0.6).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), sample=1000).toPandas()
    want = brute_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    hits = sum(len(set(want[q]) & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * 5 * len(want) and len(got) == 5 * len(want)
    assert got.groupby("query_id")["rank"].apply(list).map(lambda r: sorted(r) == [1, 2, 3, 4, 5]).all()


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None),
            (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0]), (8, []),
            (9, [0.0, 1.0]), (9, [0.0, 1.0]), (None, [1.0, 1.0]), (10, [1.0]), (50, [1e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>") \
        .withColumn("v", F.lit("clash")).withColumn("leaf", F.lit("clash"))
    got = neighbours.nearest(df, df, k=3).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == [1, 2, 50]
    assert got[got.query_id == 0].score.round(12).tolist() == [1, 1, round(0.5 ** 0.5, 12)]
    assert sorted(set(got.query_id)) == [0, 1, 2, 9, 50]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else [float(i), 1.0, 0.0]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id IN (1, 5999)"), k=3)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id").collect())) == [
        (1, 1, 3), (1, 2, 5), (1, 3, 7), (5999, 1, 1), (5999, 2, 3), (5999, 3, 5)]


def brute_profile(texts, size):
    count = Counter()
    for t in texts:
        count.update(language.grams(t).tolist())
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_profiles_and_distance_by_brute_force(spark, tables):
    docs = documents(spark, tables)
    train = docs.where(~language.held_out(F.col("doc_id")))
    profiles = language.learn_profiles(train)
    pdf = train.toPandas()
    want = {lang: brute_profile(g["text"], 400) for lang, g in pdf.groupby("lang")}
    assert {k: v.tolist() for k, v in profiles.items()} == want
    got = {r["doc_id"]: r for r in language.predict_language(docs, profiles).collect()}
    for r in docs.limit(40).collect():
        own = brute_profile([r["text"]], 400)
        away = {lang: sum(abs(p.index(g) - i) if g in p else 400 for i, g in enumerate(own))
                for lang, p in want.items()}
        best = min(sorted(away), key=away.get)
        assert got[r["doc_id"]]["lang_pred"] == best
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - away[best] / (400 * len(own)))


def test_language_accuracy_on_held_out(spark, tables):
    docs = documents(spark, tables)
    out = driver.queries()["op8_rank_order_language"](spark, tables) \
        .join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_language_of_odd_rows(odd_docs, no_docs):
    profiles = language.learn_profiles(odd_docs)
    assert set(profiles) == {"en", "fr", "de", "es"}
    rows = language.predict_language(odd_docs, profiles).collect()
    und = [r["doc_id"] for r in rows if r["lang_pred"] == "und"]
    assert sorted(i or 0 for i in und) == [0, 1, 2, 3, 15] and len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.learn_profiles(no_docs) == {}
    assert language.predict_language(no_docs, {}).count() == 0


def brute_counts(text):
    words, seen, dup, covered = WORD.findall(text or ""), set(), 0, set()
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup,
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_base_counts(spark, tables, odd_docs, no_docs):
    for docs in (documents(spark, tables), odd_docs):
        want = sorted(brute_counts(r["text"]) for r in docs.select("text").collect())
        got = quality.quality(docs, None).collect()
        assert sorted(tuple(r[1:7]) for r in got) == want
        assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.quality(no_docs, None).count() == 0


def test_viterbi_by_brute_force():
    draw = np.random.default_rng(2)
    chain = quality.Chain(draw.normal(size=(2, 3)), draw.normal(size=2), draw.normal(size=(2, 2)))
    first = np.array([0, 0, 5, 6, 14])
    lines = quality.Lines(np.ones(14), draw.normal(size=(14, 3)), first)
    got = quality.viterbi(lines, chain).astype(int)
    score = lines.measures @ chain.weights.T
    for a, b in zip(first, first[1:]):
        paths = [[x >> i & 1 for i in range(b - a)] for x in range(2 ** (b - a))] if b > a else []
        total = [chain.start[p[0]] + sum(score[a + i, s] for i, s in enumerate(p)) +
                 sum(chain.step[x, y] for x, y in zip(p, p[1:])) for p in paths]
        if paths:
            assert got[a:b].tolist() == paths[int(np.argmax(total))]


def test_quality_separates_labelled_documents(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = documents(spark, root), table(spark, root, "labels")
    out = quality.quality(docs, quality.learn_chain(docs, labels)).join(labels, "doc_id").toPandas()
    good, bad = out[(out.quality == 1) & ~out.base_failed], out[out.quality == 0]
    assert good.kept.mean() > 0.99 and bad.kept.mean() < 0.1
    assert quality.learn_chain(docs, labels.where("quality = 1")) is None
    assert quality.learn_chain(docs, labels.limit(0)) is None


def test_pipeline_stages(spark, tables):
    docs = documents(spark, tables)
    labels = table(spark, tables, "labels")
    stages = dict(corpus_pipeline.STAGES)
    one = put(stages["quality_rules"](spark, docs, tables), "test")
    verdicts = quality.quality(docs, quality.learn_chain(docs, labels))
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {
        r["doc_id"] for r in verdicts.where("kept").collect()}
    two = put(stages["near_duplicates"](spark, one, tables), "test")
    sets = {r["doc_id"]: r["text"] for r in one.collect()}
    from tests.llm.test_dedup import brute_components
    want = {r[0] for r in brute_components(list(sets.items()), 5, 80) if r[3]}
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == want
    three = put(stages["repeated_passages"](spark, two, tables), "test")
    assert three.columns == docs.columns
    assert three.where(F.length("text") != F.col("n_chars")).count() == two.where(
        F.length("text") != F.col("n_chars")).count()
    four = put(stages["source_mix"](spark, three, tables), "test")
    drawn = mixing.mix_sources(three).where("_sampled")
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in drawn.collect()}
    five = stages["packing"](spark, four, tables)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}


def test_pipeline_of_odd_rows(spark, odd_docs, tables):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = put(stage(spark, docs, tables), f"test-{name}")
    assert docs.count() > 0


def test_every_query_runs(spark, tables):
    names = [q for q in driver.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    n = documents(spark, tables).count()
    for name in names:
        if not name.startswith(("op2_", "op5_")):
            assert driver.queries()[name](spark, tables).count() == n
    assert isinstance(driver.queries()["op5_kmeans_tree_neighbours"](spark, tables).toPandas(),
                      pd.DataFrame)

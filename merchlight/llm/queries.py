"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession, functions as F

from merchlight.llm import (
    alignment, curve_packing, id_files, language, merkle, mixing, near_dedup, neighbours, packing,
    passages, quality, suffix_dedup, token_counts)
from merchlight.llm.common import documents, new_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_near_dedup(spark, root):
    return near_dedup.near_duplicates(documents(spark, root), shingle=2, percent=80)


ORACLES["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
classes AS MATERIALIZED (
  SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS MATERIALIZED (SELECT c, n, unnest(s) AS x FROM classes),
pairs AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c < b.c
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(c, r) AS (
  SELECT c, c FROM classes UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON reach.c = l.a),
lowest AS (SELECT c, min(r) AS r FROM reach GROUP BY c)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles,
  coalesce(lowest.r, sets.doc_id) AS component_id,
  coalesce(lowest.r, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN lowest ON classes.c = lowest.c
"""


@query
def op2_best_fit_packing(spark, root):
    return packing.pack_documents(documents(spark, root), path("byte_bpe_50k.json"))


@query
def op3_token_counts(spark, root):
    return token_counts.count_tokens(documents(spark, root), path("piece_bpe_32k.model"),
                                     limit=4096)


@query
def op10_line_labelling_quality(spark, root):
    docs = documents(spark, root)
    return quality.quality(docs, quality.learn_chain(docs, table(spark, root, "labels")))


@query
def op4_mixing_sources(spark, root):
    return mixing.mix_sources(documents(spark, root)).select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"),
        F.col("_n_tokens").alias("n_tokens"), F.col("_probability").alias("probability"),
        F.col("_sampled").alias("sampled"))


def _mixing_sql() -> str:
    kinds = ("source", "lang", "topic")
    parts = [r"""marked AS MATERIALIZED (SELECT doc_id, source, lang,
  coalesce(source, 'unknown') AS source_, coalesce(lang, 'unknown') AS lang_,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[0-9]{3}')
    THEN 'figures' ELSE 'prose' END AS topic_,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents)""",
             """cells AS MATERIALIZED (SELECT source_, lang_, topic_, sum(n)::DOUBLE AS t
  FROM marked GROUP BY ALL HAVING sum(n) > 0)"""]
    for kind in kinds:
        parts.append(f"""target_{kind} AS MATERIALIZED (SELECT {kind}_,
  s / (sum(s) OVER ()) * (SELECT sum(t) FROM cells) AS target, 1.0::DOUBLE AS x0
  FROM (SELECT {kind}_, pow(sum(t), {mixing.POWERS[kind]}) AS s FROM cells GROUP BY 1))""")
    now = {kind: f"(SELECT {kind}_, x0 AS x FROM target_{kind})" for kind in kinds}
    for k in range(mixing.ROUNDS):
        for kind in kinds:
            a, b = (other for other in kinds if other != kind)
            parts.append(f"""{kind}_{k} AS MATERIALIZED (SELECT {kind}_, any_value(target) /
  sum(t * a.x * b.x) AS x FROM cells JOIN {now[a]} a USING ({a}_) JOIN {now[b]} b USING ({b}_)
  JOIN target_{kind} USING ({kind}_) GROUP BY 1)""")
            now[kind] = f"{kind}_{k}"
    parts.append(f"""ratios AS MATERIALIZED (SELECT source_, lang_, topic_,
  s.x * l.x * p.x AS r FROM cells JOIN {now['source']} s USING (source_)
  JOIN {now['lang']} l USING (lang_) JOIN {now['topic']} p USING (topic_))""")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic_ AS topic, n AS n_tokens,
  round(coalesce(r / (SELECT max(r) FROM ratios), 0), 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':1'), 1, 12))::BIGINT / 281474976710656.0
    < round(coalesce(r / (SELECT max(r) FROM ratios), 0), 6) AS sampled
FROM marked LEFT JOIN ratios USING (source_, lang_, topic_)"""


ORACLES["op4_mixing_sources"] = _mixing_sql()


@query
def op7_compact_window_dedup(spark, root):
    docs = documents(spark, root).select("doc_id", "text")
    return passages.remaining(docs, passages.repeated_passages(docs)).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


@query
def op9_suffix_array_dedup(spark, root):
    return suffix_dedup.repeated_bytes(documents(spark, root), width=200)


@query
def op5_kmeans_tree_neighbours(spark, root):
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query
def op8_rank_order_language(spark, root):
    docs = documents(spark, root)
    held_out = language.held_out(F.col("doc_id"))
    profiles = language.learn_profiles(docs.where(~held_out))
    return language.predict_language(docs, profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op6_range_coded_ids(spark, root):
    target = new_path(spark, "llm-ids")
    id_files.write_ids(documents(spark, root), target, path("word_bpe_49k.json"), end_id=2)
    return id_files.read_ids(spark, target)


@query
def op11_hilbert_packing(spark, root):
    return curve_packing.pack_neighbours(documents(spark, root), path("byte_bpe_50k.json"))


@query
def op12_identity_map_alignment(spark, root):
    return alignment.align(documents(spark, root), path("byte_bpe_50k.json"),
                           path("piece_bpe_32k.model"))


@query
def op13_merkle_manifest(spark, root):
    """Every third document (by checksum of its id) is found with its letters lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
                     F.translate("text", upper, upper.lower()))
    return merkle.verify(merkle.manifest(documents(spark, root), altered))


def _merkle_sql(depth: int = 8, top_depth: int = 4) -> str:
    """Trees of up to 8^depth documents a language and 8^top_depth languages."""
    def field(name):
        return (f"CASE WHEN {name} IS NULL THEN '-' ELSE "
                f"strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END")

    def leaf(text):
        return "sha256(" + " || ".join(
            [*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"

    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
    parts = [f"""found AS MATERIALIZED (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM documents)""",
             f"""leaves AS MATERIALIZED (SELECT doc_id, t, h, now, i, row_number() OVER () AS id FROM (
  SELECT doc_id, t, h, now, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i
  FROM (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf('text')} AS h, {leaf('now')} AS now
  FROM found)))""",
             "a0 AS MATERIALIZED (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS n FROM leaves)"]

    def tree(p, levels):
        for k in range(levels):
            parts.append(f"""{p}r{k} AS MATERIALIZED (SELECT t, i // 8 AS r, list(h ORDER BY i) AS hs,
  any_value((n + 7) // 8) AS n FROM {p}{k} WHERE n > 1 GROUP BY t, i // 8)""")
            parts.append(f"""{p}{k + 1} AS MATERIALIZED (SELECT t, r AS i,
  sha256(array_to_string(hs, '')) AS h, n FROM {p}r{k})""")
        ends = " UNION ALL ".join(f"SELECT t, h FROM {p}{k} WHERE n = 1" for k in range(levels + 1))
        parts.append(f"{p}_roots AS MATERIALIZED ({ends})")

    def climb(p, runs, levels):
        for k in range(levels):
            left = "array_to_string(hs[1:(i % 8)], '')"
            right = "array_to_string(hs[(i % 8) + 2:], '')"
            parts.append(f"""{p}{k + 1} AS MATERIALIZED (SELECT id, d.t, i // 8 AS i,
  CASE WHEN hs IS NULL THEN now ELSE sha256({left} || now || {right}) END AS now,
  CASE WHEN hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof
  FROM {p}{k} d LEFT JOIN {runs}r{k} x ON d.t = x.t AND d.i // 8 = x.r)""")

    tree("a", depth)
    parts.append("""names AS MATERIALIZED (SELECT t AS name, h, row_number() OVER (ORDER BY t) - 1 AS i
  FROM a_roots)""")
    parts.append("b0 AS MATERIALIZED (SELECT '' AS t, i, h, count(*) OVER () AS n FROM names)")
    tree("b", top_depth)
    parts.append("p0 AS MATERIALIZED (SELECT id, t, i, now, '' AS proof FROM leaves)")
    climb("p", "a", depth)
    parts.append(f"""q0 AS MATERIALIZED (SELECT id, '' AS t, names.i, now, proof
  FROM p{depth} JOIN names ON p{depth}.t = names.name)""")
    climb("q", "b", top_depth)
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaves.h AS leaf, a_roots.h AS subroot, b_roots.h AS root,
  sha256(proof) AS proof_sha256, q.now AS folded_root, q.now = b_roots.h AS verified
FROM leaves JOIN q{top_depth} q USING (id) JOIN a_roots ON leaves.t = a_roots.t CROSS JOIN b_roots"""


ORACLES["op13_merkle_manifest"] = _merkle_sql()

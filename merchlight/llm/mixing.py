"""Mixing sources to target weights by iterative proportional fitting.

Documents are added up to one row per (source, language, topic), and token weights
of these cells are raked until their marginals are the targets: each marginal in
turn gets the factor that puts its sums right. Cells are joined with one small table
of factors per marginal. All of it is DataFrame operations; the number of cells and
factors depends on the distinct values, not on the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchlight.llm.common import discard, put

SPACE = r"[ \t-\r]"
ROUNDS = 6
#: A marginal's target shares are its token shares to this power, made to add up to 1.
POWERS = {"source": 0.9, "lang": 0.9, "topic": 1.0}


def n_words(text: Column) -> Column:
    """Words between white space; 0 for null and empty."""
    edge = lambda at: F.substring(text, at, 1).rlike(SPACE).cast("int")
    return F.when(F.length(text) > 0, F.size(F.split(text, SPACE + "+")) - edge(1) - edge(-1)) \
        .otherwise(0).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic: texts with figures, with tables, or prose."""
    return F.when(F.instr(text, " | ") > 0, "table") \
        .when(text.rlike("[0-9]{3}"), "figures").otherwise("prose")


def mix_sources(docs: DataFrame, *, topic: Column | None = None, powers: dict | None = None,
                rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """``docs`` (its columns) with ``_topic, _n_tokens, _probability, _sampled``.

    The probability is a cell's raked weight per token, scaled so that the largest is
    1; a document is sampled if the md5 of its id and the seed, as a fraction, lies
    below it. A null source, language or topic is a value of its own. Cells without
    tokens have probability 0. Repeated rows are drawn alike, rows without id as one.
    An empty table gives an empty result.
    """
    powers = powers or POWERS
    text = F.col("text").cast("string")
    # the documents' own columns travel as one struct, so that no name can clash
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(topic_of(text) if topic is None else topic, F.lit("unknown")).alias("_topic"),
        n_words(text).alias("_n_tokens"),
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("_lang"))
    kinds = {"source": "_source", "lang": "_lang", "topic": "_topic"}
    cells = put(marked.groupBy(*kinds.values()).agg(F.sum("_n_tokens").alias("_t"))
                .where("_t > 0"), "cells")
    total = cells.agg(F.sum("_t")).first()[0] or 0
    targets = {}
    for kind, column in kinds.items():
        by = cells.groupBy(column).agg(F.pow(F.sum("_t"), F.lit(powers[kind])).alias("_s"))
        whole = by.agg(F.sum("_s")).first()[0] or 1.0
        targets[kind] = put(by.select(column, (F.col("_s") / whole * total).alias("_target")),
                            "target")
    factors = {kind: put(t.select(t.columns[0], F.lit(1.0).alias(f"_{kind}_x")), "factor")
               for kind, t in targets.items()}

    def weighed(kinds_used) -> tuple[DataFrame, Column]:
        rows, weight = cells, F.col("_t").cast("double")
        for kind in kinds_used:
            rows = rows.join(factors[kind], kinds[kind])
            weight = weight * F.col(f"_{kind}_x")
        return rows, weight

    for _ in range(rounds):
        for kind, column in kinds.items():
            rows, weight = weighed([k for k in kinds if k != kind])
            sums = rows.groupBy(column).agg(F.sum(weight).alias("_w"))
            fresh = put(targets[kind].join(sums, column).select(
                column, (F.col("_target") / F.col("_w")).alias(f"_{kind}_x")), "factor")
            discard(factors[kind])
            factors[kind] = fresh
    rows, weight = weighed(kinds)
    ratios = put(rows.select(*kinds.values(), (weight / F.col("_t")).alias("_ratio")), "ratios")
    top = ratios.agg(F.max("_ratio")).first()[0] or 1.0
    draw = F.conv(F.substring(F.md5(F.concat(
        F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12),
        16, 10).cast("double") / F.lit(float(16 ** 12))
    return marked.join(ratios, [*kinds.values()], "left").withColumn(
        "_probability", F.round(F.coalesce(F.col("_ratio") / top, F.lit(0.0)), 6)).select(
        "row.*", "_topic", "_n_tokens", "_probability",
        (draw < F.col("_probability")).alias("_sampled"))

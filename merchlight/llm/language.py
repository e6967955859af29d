"""Language of a text by rank-order profiles of its n-grams.

A text is lower-cased, its letters become small codes and every run of other
characters one gap. The profile of a language is its most frequent n-grams of 1 to 3
codes in order, from counts over all training texts, added up in each task before
they are shuffled. A text goes to the language whose profile has the smallest
out-of-place distance: over the text's own most frequent n-grams, the sum of
differences of rank, with a fixed penalty for n-grams that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from merchlight.llm.common import keyed_text, put, slices

#: N-grams in a profile, of a language and of a text.
PROFILE = 400
#: Codes of characters: 0 is a gap, 1 to 26 are a to z, other letters share the rest.
CODES = 128
SPACE = CODES ** 3
UNKNOWN = "und"

_codes = np.zeros(0x110000, np.uint8)


def character_codes() -> np.ndarray:
    """A code for every character, filled once in each worker."""
    if not _codes.any():
        letters = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
        places = np.flatnonzero(letters)
        _codes[places] = 27 + (places * 40503 >> 3) % (CODES - 27)
        _codes[97:123] = np.arange(1, 27)
    return _codes


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers below ``SPACE``, in no order; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = character_codes()[points].astype(np.uint32)
    letters = codes > 0
    keep = letters.copy()
    keep[1:] |= letters[:-1]                   # of a run of gaps the first stays
    codes = np.concatenate((np.zeros(1, np.uint32), codes[keep], np.zeros(1, np.uint32)))
    if not letters.any():
        return codes[:0]
    pairs = codes[:-1] * CODES + codes[1:]
    triples = pairs[:-1] * CODES + codes[2:]
    middle = (codes[:-2] > 0) & (codes[1:-1] == 0) & (codes[2:] > 0)
    return np.concatenate((codes[codes > 0], pairs[pairs >= CODES], triples[~middle]))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def learn_profiles(docs: DataFrame, profile: int = PROFILE, *, text_col: str = "text",
                   lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The ranked n-grams of each language of the rows with text and language.

    Ties of counts go to the smaller n-gram. The result holds ``profile`` numbers for
    each language, whatever the number of rows.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")) \
        .where("text IS NOT NULL AND lang IS NOT NULL")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for lo, hi in slices(texts):
                for lang in set(langs[lo:hi].tolist()):
                    own = [grams(texts[i]) for i in range(lo, hi) if langs[i] == lang]
                    keys, n = counted(np.concatenate(own))
                    if lang in sums:
                        both = np.concatenate((sums[lang][0], keys))
                        keys, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, np.concatenate((sums[lang][1], n))).astype(np.int64)
                    sums[lang] = keys, n
        for lang, (keys, n) in sums.items():
            yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)),
                                   pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    totals = rows.mapInArrow(summed, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = put(totals.withColumn("rank", F.row_number().over(order))
                 .where(F.col("rank") <= profile), "profiles")
    out: dict[str, list] = {}
    for row in ranked.orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(keys) for lang, keys in out.items()}


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], *,
                     id_col: str = "doc_id", text_col: str = "text",
                     profile: int = PROFILE) -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score`` from the text alone.

    The score is 1 less the distance as a share of the largest possible. ``und`` with
    score 0 if the text is null or has no letter, or nothing was learned; ties go to
    the first language by name. Other columns are ignored; an empty table gives an
    empty result.
    """
    names = sorted(profiles)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.full((len(names), SPACE), profile, np.int16)
        for k, name in enumerate(names):
            ranks[k, profiles[name]] = np.arange(len(profiles[name]))
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                keys, n = counted(grams(text or ""))
                if not len(keys) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                top = keys[np.argsort(-n, kind="stable")[:profile]]
                theirs = ranks[:, top]
                away = np.where(theirs == profile, profile,
                                np.abs(theirs - np.arange(len(top)))).sum(axis=1)
                best = int(away.argmin())
                langs.append(names[best])
                scores.append(1.0 - float(away[best]) / (profile * len(top)))
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()),
                                   pa.array(scores, pa.float64())],
                                  names=["doc_id", "lang_pred", "score"])

    return keyed_text(docs, id_col, text_col).mapInArrow(
        predicted, "doc_id long, lang_pred string, score double")

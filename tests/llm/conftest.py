from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame

from tests.conftest import TABLES  # noqa: F401

LETTERS = "abcdefghijklmnopqrstuvwxyzé"


def prose(words: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(LETTERS) for _ in range(draw.randint(2, 8)))
                    for _ in range(words))


PASSAGE = prose(80, 999)
#: id, text, lang, source: empty, null, short, repeated, copied, near and long texts,
#: ids that are null or used twice, and a passage that several texts share
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "a"),
    (5, "One\n", "fr", "b"), (6, prose(120, 1), "en", "a"), (7, prose(120, 1), "en", None),
    (7, prose(120, 1), "en", None), (8, prose(120, 1) + " tail end", "en", "b"),
    (9, prose(60, 2) + "\n" + PASSAGE + "\n" + prose(60, 3), "fr", "b"),
    (10, prose(70, 4) + " " + PASSAGE + " " + prose(50, 5), "fr", "c"),
    (11, PASSAGE + " " + PASSAGE, "de", "c"), (12, "aaaa" * 300, "de", "c"),
    (None, prose(120, 1), "en", "a"), (None, None, None, None), (13, prose(6000, 6), "es", "d"),
    (14, "the the the the " * 40, "en", "a"), (15, "12 34 !! ##", "en", "a"),
    (16, "x\r\ny\t z w  <|endoftext|> \x01 \x00", "en", "a"),
    (17, prose(90, 7), "en", "a"), (17, prose(90, 8), "en", "a"),
]
#: names that the operators use inside
CLASHES = ["node", "t", "h1", "length", "_n", "_id", "_spans", "_text", "n", "f", "lang_pred",
           "tree", "_source", "score", "row", "text_hash"]


@pytest.fixture(scope="session")
def odd_docs(spark) -> DataFrame:
    docs = spark.createDataFrame(
        [(i, t, lang, s, len(t or "")) for i, t, lang, s in ROWS],
        "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'clash' AS `{name}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs) -> DataFrame:
    return odd_docs.limit(0)

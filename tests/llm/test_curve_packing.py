"""Packing along the Hilbert curve: the curve's steps, exact pieces, no padding, neighbours."""

import itertools
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from merchlight.llm import curve_packing, queries
from tests.conftest import TABLES
from tests.llm.conftest import ROWS, prose

BYTES = path("byte_bpe_50k.json")
library = Tokenizer.from_file(BYTES)


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 3), (4, 2), (4, 3)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.int64)
    keys = curve_packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check_pieces(rows, docs, capacity):
    """Every id of every document in one piece, sequences gapless, without padding."""
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
           for _, t in docs]
    want = sorted((i is None, i or 0, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(docs, ids))
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    # repeated rows of one id and length share a list here, so their pieces are counted
    texts = {}
    for (i, _), x in zip(docs, ids):
        texts.setdefault((i is None, i or 0, len(x)), []).append(x)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == key[2] * len(texts[key])
        held = {(p["start"], p["length"], p["ids_crc32"]) for p in pieces}
        assert all(any(zlib.crc32(x[s:s + n].tobytes()) == crc for x in texts[key])
                   for s, n, crc in held)
        if len(texts[key]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    return want


def test_odd_rows(odd_docs, no_docs):
    for capacity in (64, 1024):
        rows = curve_packing.pack_neighbours(odd_docs, BYTES, capacity=capacity).collect()
        check_pieces(rows, [(i, t) for i, t, *_ in ROWS], capacity)
    assert curve_packing.pack_neighbours(no_docs, BYTES).count() == 0


def test_query_packs_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet")
            .select("doc_id", "text").collect()]
    rows = queries.op11_hilbert_packing(spark, TABLES)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                            "sequence_id", "offset"]
    check_pieces(rows.collect(), docs, 1024)


def test_keys_do_not_depend_on_other_documents():
    words = [prose(80, s) for s in range(30)]
    def keys(texts):
        tokens = [library.encode(t, add_special_tokens=False).ids for t in texts]
        first = np.cumsum([0, *map(len, tokens)])
        table = curve_packing.directions(50_257)
        return curve_packing.hilbert_keys(curve_packing.quantised(
            curve_packing.document_vectors(np.array(sum(tokens, [])), first, table))).tolist()
    assert keys(words) == [keys([w])[0] for w in words]


def test_documents_on_one_topic_are_neighbours(spark):
    """Two documents in a row share their topic several times as often as by chance."""
    draw, topics = random.Random(3), 20
    words = [prose(40, 100 + t).split() for t in range(topics)]
    shared = prose(60, 99).split()
    docs = [(i, " ".join(draw.choice(words[i % topics] if draw.random() < 0.6 else shared)
                         for _ in range(150))) for i in range(600)]
    keyed = curve_packing.curve_keys(spark.createDataFrame(docs, "doc_id long, text string"), BYTES)
    along = [r["doc_id"] % topics for r in keyed.orderBy("key").collect()]
    alike = sum(a == b for a, b in zip(along, along[1:])) / (len(along) - 1)
    assert alike > 4 / topics


def test_copies_are_side_by_side(spark):
    docs = [(i, prose(50, i % 40)) for i in range(200)]
    rows = curve_packing.pack_neighbours(
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), BYTES).collect()
    along = []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        if not along or along[-1] != r["doc_id"] % 40:
            along.append(r["doc_id"] % 40)
    assert len(along) == 40

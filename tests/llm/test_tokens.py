"""Tokens, packing, id files: against the libraries and by exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from merchlight.llm import id_files, packing, range_coder, token_counts
from merchlight.llm.common import new_path
from merchlight.llm.tokens import Encoder
from tests.llm.conftest import ROWS

TEXTS = st.lists(st.text(alphabet="the an\n\t\r  ,.'sé中▁\x01 <|>ENDoftx19", max_size=60), max_size=6)
library = {f: Tokenizer.from_file(path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}
encoders = {f: Encoder(path(f)) for f in library}
pieces = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


@pytest.mark.parametrize("name", sorted(library))
@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_encoder_equals_library(name, texts):
    ids, first = encoders[name].encode([t.encode() for t in texts])
    for t, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == library[name].encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(texts=TEXTS)
def test_counts_equal_library(texts):
    merges = token_counts.merger(path("piece_bpe_32k.model"))
    got = merges.count([t.encode() for t in texts])
    assert got.tolist() == [len(pieces.encode(t)) for t in texts]


def test_counts_of_odd_rows(odd_docs, no_docs):
    got = token_counts.count_tokens(odd_docs, path("piece_bpe_32k.model"), limit=100)
    want = []
    for i, t, *_ in ROWS:
        n = len(pieces.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 100))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(no_docs, path("piece_bpe_32k.model")).count() == 0


def ids_of(name, text, end):
    ids = library[name].encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, path("byte_bpe_50k.json"), capacity=256).collect()
    assert max(r["offset"] + r["length"] for r in rows) <= 256
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    want = []
    for i, t, *_ in ROWS:
        ids, at = ids_of("byte_bpe_50k.json", t, 0), 0
        for k, stop in enumerate(range(len(ids) % 256 or 256, len(ids) + 1, 256)):
            want.append((i, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
            at = stop
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    assert packing.pack_documents(no_docs, path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 60), st.lists(st.integers(1, 60), max_size=120))
def test_plan_places_every_piece_once(capacity, lengths):
    lengths = [n for n in lengths if n <= capacity]
    plan = packing.plan_sequences(np.bincount(lengths, minlength=capacity + 1), capacity)
    used, seen = {}, {n: [] for n in lengths}
    for length, rank, number, sequence, offset in plan.tolist():
        seen[length] += range(rank, rank + number)
        for k in range(number):
            used.setdefault(sequence + k, []).append((offset, length))
    assert all(sorted(r) == list(range(lengths.count(n))) for n, r in seen.items())
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= capacity
        assert sum(n > capacity / 3 for _, n in places) <= 2
    if lengths:                       # never worse than first fit by falling length
        bins = []
        for n in sorted(lengths, reverse=True):
            for k, room in enumerate(bins):
                if room >= n:
                    bins[k] -= n
                    break
            else:
                bins.append(capacity - n)
        assert len(used) <= len(bins) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 69999)), max_size=700),
       st.sampled_from([1, 7, 64, 1024]))
def test_coder_round_trip(ids, block):
    payload = range_coder.encode(np.array(ids, np.int64), 70000, block)
    assert range_coder.decode(payload).tolist() == ids


def test_coder_tells_damage_and_predicts():
    ids = np.tile(np.arange(300), 40)
    payload = bytearray(range_coder.encode(ids, 49408))
    assert len(payload) < len(ids)               # far below the 15.6 bits of an even choice
    payload[-100] ^= 4
    with pytest.raises(range_coder.Damaged):
        range_coder.decode(bytes(payload))
    with pytest.raises(ValueError):
        range_coder.encode(np.array([5]), 5)


def test_id_files_of_odd_rows(spark, odd_docs, no_docs):
    target = new_path(spark, "test-ids")
    id_files.write_ids(odd_docs, target, path("word_bpe_49k.json"))
    got = sorted(map(tuple, id_files.read_ids(spark, target).collect()), key=lambda r: r[1])
    ids = [i for i, *_ in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    want = [(i, ids_of("word_bpe_49k.json", t, 2)) for i, t, *_ in ROWS]
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted(
        (i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    empty = new_path(spark, "test-ids")
    id_files.write_ids(no_docs, empty, path("word_bpe_49k.json"))
    assert id_files.read_ids(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_and_other_words_have_the_library_s_ids(name):
    texts = ["Café!! ÉCOLE\nÁ x÷y Àß. ×× œuf", "don't it''s é a_b ab_ ab__ 12ab ab12.",
             "a b a  b", "<|endoftext|> x<|endoftext|>", "New\nline's end. (so)", "", "...", "ZÜRICH\nZürich,"]
    encode = Encoder(path(name))
    whole = [encode.library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):                          # new words, then known ones
        ids, first = encode.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == whole

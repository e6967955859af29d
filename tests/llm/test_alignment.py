"""Alignment of two tokenizers: against brute force over every pair of tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from merchlight.llm import alignment, queries
from tests.conftest import TABLES
from tests.llm.conftest import ROWS

FILES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=FILES[1])
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
HIDDEN = [b for b in range(256) if b not in SHOWN]
BYTE = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(HIDDEN)}


def bytes_a(i):
    return bytes(BYTE[c] for c in A.id_to_token(i))


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def spans(ids, bytes_of):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(bytes_of(i)), i))
        at = out[-1][1]
    return out


def brute(text):
    """Tokens of A and B, groups, links as pairs, digest; None if nothing is aligned."""
    if not text:
        return None
    a, b = (spans(ids, of) for ids, of in ((A.encode(" " + text, add_special_tokens=False).ids, bytes_a),
                                           (B.encode(text), bytes_b)))
    if any(b"".join(of(i) for *_, i in x) != b" " + text.encode() for x, of in ((a, bytes_a), (b, bytes_b))):
        return None
    links, j = [], 0
    for s, e, i in a:
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            links.append((i, b[k][2]))
            k += 1
    ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    group = {e: g for g, e in enumerate(ends)}
    sides = [[[], []] for _ in ends]
    for side, tokens in enumerate((a, b)):
        for _, e, i in tokens:
            sides[group[min(x for x in ends[np.searchsorted(ends, e):])]][side].append(str(i))
    shown = ";".join("|".join(",".join(x) for x in g) for g in sides)
    return len(a), len(b), len(ends), links, hashlib.sha256(shown.encode()).hexdigest()


def rows_of(texts):
    """The expected columns after the id, of all texts of a table."""
    found = [brute(t) for t in texts]
    counts = Counter(x for f in found if f for x in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (*f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]),
             sum(counts[x] for x in f[3]), f[4]) for f in found]


TEXTS = st.lists(st.text(alphabet="the of an\n\t\r  ,.'sé中▁\x01\x1c\x85  ß😀<|>ENDoftx19", max_size=40),
                 max_size=5)


@settings(max_examples=200, deadline=None)
@given(texts=TEXTS, plain=st.booleans())
def test_texts_align_as_by_brute_force(texts, plain):
    texts = [" ".join(t.split()) for t in texts] if plain else texts
    both = alignment.aligner(*FILES)
    columns = [c.to_pylist() for c in both.align([t.encode() for t in texts])]
    for text, *numbers, digest, exact, pairs, times in zip(texts, *columns):
        want = brute(text) or (0, 0, 0, [], "")
        assert (*numbers, digest) == (*want[:3], len(want[3]), want[4])
        got = Counter(dict(zip(pairs, times)))
        got.update(x << alignment.ID_BITS | int(both.same[x])
                   for x in np.frombuffer(exact, both.words).tolist())
        assert got == Counter(a << alignment.ID_BITS | b for a, b in want[3])


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("known", [alignment.KNOWN_PAIRS, 8, 0])
def test_odd_rows(odd_docs, no_docs, monkeypatch, known):
    """Counts hold whether pairs are looked up or joined."""
    monkeypatch.setattr(alignment, "KNOWN_PAIRS", known)
    want = [(i, *r) for (i, *_), r in zip(ROWS, rows_of([t for _, t, *_ in ROWS]))]
    assert ordered(alignment.align(odd_docs, *FILES).collect()) == ordered(want)
    assert alignment.align(no_docs, *FILES).count() == 0


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_WORDS", 3)
    both = alignment.Aligner(*FILES)
    texts = ["some words here", "and other words there", "some words here\nagain", "", "x"]
    for _ in range(3):
        for t in texts:
            assert both.align([t.encode()])[4][0].as_py() == (brute(t) or [""] * 5)[4]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    want = [(r["doc_id"], *x) for r, x in zip(docs, rows_of([r["text"] for r in docs]))]
    got = queries.op12_identity_map_alignment(spark, TABLES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups_sha256"]
    assert ordered(got.collect()) == ordered(want)

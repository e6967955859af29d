"""Token counts of whole texts under a byte-fallback BPE vocabulary of pieces.

The merges run here on arrays: the new words of a slice of texts are one ragged array
of symbols, and in every round each word's pair of lowest rank is merged, all words
at once, until no pair is known. What survives is counted; a character that is no
piece counts as its bytes. In these vocabularies no piece holds the space mark after
another character, so words are independent, and a worker keeps their counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from merchlight.llm.common import keyed_text, slices, starts_of, utf8
from merchlight.llm.tokens import KnownWords
from merchlight.llm.words import SPACE, U64, mix, words_of

MARK = "▁"
NEVER = np.iinfo(np.int64).max


def count_tokens(docs: DataFrame, model: str, *, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null and empty texts count 0. Repeated rows and rows without id are counted like
    others; other columns are ignored; an empty table gives an empty result.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merger(model)
        for batch in batches:
            texts, tokens = utf8(batch.column(1)), []
            for lo, hi in slices(texts, 2 << 20):
                tokens.append(merges.count(texts[lo:hi]))
            tokens = np.concatenate([*tokens, np.zeros(0, np.int64)])
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(tokens),
                                   pa.array(tokens > limit)],
                                  names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return keyed_text(docs, id_col, text_col).mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@lru_cache(maxsize=2)
def merger(model: str) -> Merger:
    from sentencepiece import SentencePieceProcessor
    library = SentencePieceProcessor(model_file=model)
    pieces = {library.id_to_piece(i): -library.get_score(i) for i in range(len(library))
              if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    return Merger(pieces)


class Merger:
    """pieces: each piece's rank; a pair may merge if its union is a piece."""

    def __init__(self, pieces: dict[str, float]):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the space mark inside; words are not independent")
        names = list(pieces)
        ids = {p: i for i, p in enumerate(names)}
        order = {r: k for k, r in enumerate(sorted(set(pieces.values())))}
        made = [(ids[p[:k]] * len(names) + ids[p[k:]], order[pieces[p]], i)
                for i, p in enumerate(names) for k in range(1, len(p))
                if p[:k] in ids and p[k:] in ids]
        table = np.array(sorted(made), np.int64).reshape(-1, 3)
        self.width = len(names)
        self.pair, self.rank, self.union = table.T.copy()
        # merging every occurrence at once is the same as one by one if no pair with
        # the union goes first and no other pair has the rank
        soonest = np.full(len(names), NEVER)
        for part in (self.pair // self.width, self.pair % self.width):
            np.minimum.at(soonest, part, self.rank)
        unions = {}
        for rank, union in zip(self.rank.tolist(), self.pair.tolist()):
            unions.setdefault(rank, set()).add(union)
        alone = np.array([len(unions[r]) == 1 for r in self.rank.tolist()], bool)
        self.at_once = alone & (soonest[self.union] > self.rank)
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        letters = set("".join(pieces))
        self.apart = np.array([b not in (13, 32) and chr(b) not in letters for b in range(256)])
        self.known = KnownWords()

    def count(self, texts: list[bytes]) -> np.ndarray:
        words = words_of(texts, lower=False)
        counts = words.counts()
        raw = words.bytes
        marked = np.where(words.begin > 0, raw[words.begin - 1], 32) == 32
        marked[words.first[:-1][counts > 0]] = True
        space = SPACE[raw]
        other = space & (raw != 32)
        runs = np.cumsum(np.concatenate(([0], space)))
        gaps = np.cumsum(np.concatenate(([0], other)))
        joined = np.cumsum(np.concatenate(([0], other & ~self.apart[raw])))
        lo, hi = words.offset[:-1], words.offset[1:] - 1
        odd = (runs[hi] - runs[lo] != np.maximum(counts - 1, 0)) | (joined[hi] > joined[lo])
        text = raw.tobytes()

        def learn(index: np.ndarray):
            chunks = [MARK * bool(m) + text[a:b].decode() for m, a, b in
                      zip(marked[index], words.begin[index], words.end[index])]
            size = np.ones(len(chunks), np.int64)
            return self.merge(chunks).astype(np.uint32), starts_of(size)[:-1], size

        codes = self.known.codes(mix(words.hash + marked.astype(U64)), learn)
        sums = np.concatenate(([0], np.cumsum(self.known.flat[self.known.first[codes]],
                                              dtype=np.int64)))
        out = sums[words.first[1:]] - sums[words.first[:-1]] + gaps[hi] - gaps[lo]
        for i in range(len(texts)):
            if (odd[i] or MARK.encode() in texts[i]) and texts[i]:
                whole = MARK + texts[i].decode().replace(" ", MARK)
                out[i] = self.merge(re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", whole)).sum()
        return out

    def merge(self, chunks: list[str]) -> np.ndarray:
        """How many symbols each chunk ends with."""
        letters = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        # a letter that is no piece counts its bytes and parts its neighbours
        symbol = self.symbol[letters].astype(np.int64)
        width = 1 + (letters > 0x7F) + (letters > 0x7FF).astype(np.int64) + (letters > 0xFFFF)
        weight = np.where(symbol < 0, width, 1)
        out = np.zeros(len(chunks), np.int64)
        owner = np.repeat(np.arange(len(chunks)), size)
        out += np.bincount(owner, weight, len(chunks)).astype(np.int64)
        while len(symbol) > 1:
            pair = np.where((symbol[:-1] >= 0) & (symbol[1:] >= 0) & (owner[:-1] == owner[1:]),
                            symbol[:-1] * self.width + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            rank = np.append(np.where(self.pair[at] == pair, self.rank[at], NEVER), NEVER)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(owner))
            live = np.repeat(least < NEVER, sizes)
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < NEVER))
            if not len(hit):
                break
            # of overlapping hits every other one; of pairs that must go singly the first
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
            lead = np.diff(owner[hit], prepend=-1) != 0
            take = hit[lead | (self.at_once[at[hit]] & (offset % 2 == 0))]
            symbol[take] = self.union[at[take]]
            out -= np.bincount(owner[take], minlength=len(chunks))
            live[take + 1] = False
            symbol, owner = symbol[live], owner[live]
        return out

"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Both supported vocabularies split a text before any rule looks across a single space
or line break between other characters, so the ids of a text are those of its words
in turn, each with the white space before it. A worker keeps the ids of words it has
met under their 64-bit hashes. New plain words, that is letters of ASCII and Latin-1
and then ASCII signs, go to the library's model in lines, cut where the tokenizer's
pattern cuts them; other new words go to the whole tokenizer with their offsets. Texts
with other or repeated white space go to it whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from merchlight.llm.common import ragged, starts_of
from merchlight.llm.words import LOWER, SPACE, U64, mix, words_of

#: Distinct words a worker keeps before it starts anew.
KEPT_WORDS = 3_000_000
#: Words that one call of the library gets as a line.
LINE_WORDS = 256

LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SIGN[39] = False                                # "'s" and its like are cut elsewhere
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is LATIN.
LATIN, SECOND = 0xC3, np.zeros(256, bool)
SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
#: The character that stands for a byte in both vocabularies; for byte 0: a gap.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CODES = np.zeros(256, np.uint16)
CODES[SHOWN] = SHOWN
CODES[CODES == 0] = 256 + np.arange(256 - len(SHOWN))
CODES[0] = 32


class KnownWords:
    """Ragged integer values of words, under sorted hashes."""

    def __init__(self):
        self.keys = np.zeros(0, U64)
        self.first = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def codes(self, hashes: np.ndarray, learn) -> np.ndarray:
        """Places of the hashes; ``learn(indexes)`` gives values of new ones.

        ``indexes`` point at one word of each new hash; the result is the flat
        values, and where each word's begin and how many there are.
        """
        if len(self.keys) > KEPT_WORDS:
            self.__init__()
        found, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == found[known]
        if not known.all():
            new = np.flatnonzero(~known)
            flat, first, size = learn(where[new])
            self.first = np.insert(self.first, at[new], len(self.flat) + first)
            self.size = np.insert(self.size, at[new], size)
            self.keys = np.insert(self.keys, at[new], found[new])
            self.flat = np.concatenate((self.flat, flat))
            at = np.searchsorted(self.keys, found)
        return at[inverse]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.spaced = json.load(file)["pre_tokenizer"]["type"] == "ByteLevel"
        self.known = KnownWords()
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # the ids that begin a word with its space or line break, or that end a part
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        begins = (chr(CODES[32]), chr(CODES[10]))
        self.edge[[i for piece, i in vocabulary.items() if (
            piece.startswith(begins) if self.spaced else piece.endswith("</w>"))]] = True

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin."""
        words = words_of(texts, lower=False)
        counts = words.counts()
        before = np.where(words.begin > 0, words.bytes[words.begin - 1], 10)
        starts = words.first[:-1][counts > 0]
        before[starts] = 0
        hashes = mix(words.hash + before.astype(U64)) if self.spaced else words.hash
        odd = np.zeros(len(texts), bool)
        if self.spaced:
            other = np.cumsum(np.concatenate(([0], SPACE[words.bytes])))
            spaces = other[words.offset[1:] - 1] - other[words.offset[:-1]]
            rest = np.cumsum(np.concatenate(([0], SPACE[words.bytes] & (words.bytes != 32) &
                                             (words.bytes != 10))))
            odd = (spaces != np.maximum(counts - 1, 0)) | (np.diff(rest[words.offset]) > 0)
        def learn(index: np.ndarray):
            plain, letters = self._plain(words, index, before[index])
            easy, hard = index[plain], index[~plain]
            parts = [self._learn_plain(words, easy, letters[plain], before[easy]),
                     self._learn([words.bytes[a:b].tobytes().decode() for a, b in
                                  zip(words.begin[hard], words.end[hard])], before[hard])]
            first, size = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
            for of, part, base in zip((plain, ~plain), parts, (0, len(parts[0][0]))):
                first[of], size[of] = part[1] + base, part[2]
            return np.concatenate([part[0] for part in parts]), first, size

        codes = self.known.codes(hashes, learn)
        lengths = self.known.size[codes]
        ids = self.known.flat[ragged(self.known.first[codes], lengths)]
        first = starts_of(lengths)[words.first]
        if not odd.any():
            return ids, first
        parts = [self._whole(texts[i].decode()) if odd[i] else ids[first[i]:first[i + 1]]
                 for i in range(len(texts))]
        return np.concatenate(parts), starts_of(np.array([len(p) for p in parts]))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, words, index: np.ndarray, before: np.ndarray):
        """Which words are letters and then signs, and the letters' bytes of each word."""
        size = words.end[index] - words.begin[index]
        start = starts_of(size)
        raw = words.bytes[ragged(words.begin[index], size)]
        pair = (raw[:-1] == LATIN) & SECOND[raw[1:]]
        letter = LETTER[raw]
        letter[:-1] |= pair
        letter[1:] |= pair
        total, signs = starts_of(letter), starts_of(SIGN[raw])
        letters = total[start[1:]] - total[start[:-1]]
        plain = (letters > 0) & (letters + signs[start[1:]] - signs[start[:-1]] == size)
        plain &= total[start[:-1] + letters] - total[start[:-1]] == letters
        return plain & ((before == 32) | (before == 10)) if self.spaced else plain, letters

    def _learn_plain(self, words, index: np.ndarray, letters: np.ndarray, before: np.ndarray):
        """As ``_learn``, for plain words: white space, letters and signs, with gaps."""
        size = words.end[index] - words.begin[index]
        signed = size > letters
        lead = np.where(before == 10, 2, 1) if self.spaced else np.zeros(len(index), np.int64)
        start = starts_of(lead + size + signed + 1)
        line = np.zeros(start[-1], np.uint8)
        if self.spaced:
            line[start[:-1]] = before
        own = words.bytes[ragged(words.begin[index], letters)]
        if not self.spaced:
            own = LOWER[own]
            own[1:] |= np.where((own[:-1] == LATIN) & (own[1:] < 0x9F), 32, 0).astype(np.uint8)
        line[ragged(start[:-1] + lead, letters)] = own
        line[ragged(start[:-1] + lead + letters + 1, size - letters)] = \
            words.bytes[ragged(words.begin[index] + letters, size - letters)]
        cuts = start[:-1][::LINE_WORDS].tolist() + [int(start[-1])]
        shown = CODES[line].astype("<u2")
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(self.model.encode(
            shown[a:b].tobytes().decode("utf-16-le")).ids, np.uint32)
            for a, b in zip(cuts, cuts[1:]))])
        edge = np.flatnonzero(self.edge[ids])
        if self.spaced:
            first = edge
        else:                                   # a word ends with its first or second part
            last = np.cumsum(1 + signed) - 1
            first = np.concatenate(([0], edge[last] + 1))[:-1]
        return ids, first, np.diff(first, append=len(ids))

    def _learn(self, words: list[str], before: np.ndarray):
        """Flat ids of the words, and where each word's begin and how many there are."""
        size, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, used = [], 0
        for mark in (32, 10) if self.spaced else (None,):
            index = np.arange(len(words)) if mark is None else np.flatnonzero(before == mark)
            gap = chr(mark or 32)
            own = [words[i] for i in index]
            lines = [own[i:i + LINE_WORDS] for i in range(0, len(own), LINE_WORDS)]
            done = self.library.encode_batch(
                [(gap if mark else "") + gap.join(x) for x in lines], add_special_tokens=False)
            for k, (line, encoded) in enumerate(zip(lines, done)):
                ids = np.array(encoded.ids, np.uint32)
                at = np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0]
                cuts = np.searchsorted(at, starts_of(np.array([len(w) for w in line]) + 1))
                cuts[-1] = len(ids)
                place = index[k * LINE_WORDS:k * LINE_WORDS + len(line)]
                first[place] = used + cuts[:-1]
                size[place] = np.diff(cuts)
                used += len(ids)
                parts.append(ids)
        # words after other white space stand in texts that go whole, and get nothing
        for i in np.flatnonzero(before == 0) if self.spaced else ():
            ids = self._whole(words[i])
            first[i], size[i] = used, len(ids)
            used += len(ids)
            parts.append(ids)
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), first, size

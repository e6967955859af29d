"""Range coding of token ids with mixed predictions of order 0, 1 and 2.

A sequence of ids is cut into blocks that share nothing: each starts with fresh
models, has its own checksum and can be read alone. Within a block, tables under
hashes of the last one and the last two ids predict the next id, with a confidence;
how often predictions of each confidence came true so far weighs the two against each
other and against order 0, which codes an id by adaptive counts of its high part and
an even low byte. The blocks of a payload advance together, one id each a step, so
that every operation runs on arrays over blocks.

Payload: the number of blocks, then for each block its ids, bytes and CRC-32 (of the
ids as little-endian unsigned 32-bit), then the blocks' bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"idcm"
BLOCK_IDS = 1024
SLOTS = (1 << 10, 1 << 11)    # of the tables of order 1 and 2
SURE = 8                      # levels of confidence; 0: nothing predicted yet
SCALE_BITS = 12               # of the choice between the orders
SCALE = 1 << SCALE_BITS
RATE = 4                      # a share moves by 1/16 of what it was off
REFRESH = 128                 # steps between updates of the order-0 intervals
#: Interval states have 56 bits, of which 16 leave at a time once they are settled.
BITS, TOP, BOTTOM = 56, 1 << 40, 1 << 36
MASK = (1 << BITS) - 1


class Damaged(ValueError):
    """A payload whose checksum does not hold."""


class Models:
    """The models of many blocks; of these the first ``n`` are still active."""

    def __init__(self, blocks: int, high: int):
        self.high = high
        self.table = [np.zeros(blocks * s, np.int64) for s in SLOTS]   # guess and its level
        self.base = [np.arange(blocks) * s for s in SLOTS]
        self.share = [np.full(blocks * SURE, SCALE // 2, np.int64) for _ in SLOTS]
        self.levels = np.arange(blocks) * SURE
        self.counts = np.ones(blocks * high, np.int64)
        self.rows = np.arange(blocks) * high
        self.last = [np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)]
        self.refresh()

    def refresh(self) -> None:
        grid = self.counts.reshape(-1, self.high)
        bounds = np.zeros((len(grid), self.high + 1), np.int64)
        np.cumsum(grid, axis=1, out=bounds[:, 1:])
        self.bounds, self.width = bounds.ravel(), self.high + 1

    def predict(self, n: int):
        """Guesses of order 1 and 2 and their shares of ``SCALE`` (0: no such choice)."""
        one, two = self.last[0][:n], self.last[1][:n]
        slot = ((one * 40503 >> 4) & SLOTS[0] - 1, (one * 73244475 + two * 40507 >> 7) & SLOTS[1] - 1)
        self.at = [b[:n] + s for b, s in zip(self.base, slot)]
        found = [t.take(i) for t, i in zip(self.table, self.at)]
        self.guess = [f >> 3 for f in found]
        self.level = [f & 7 for f in found]
        self.spot = [self.levels[:n] + k for k in self.level]
        self.known = [s.take(i) for s, i in zip(self.share, self.spot)]
        share_2 = self.known[1] * (self.level[1] > 0)
        apart = (self.level[0] > 0) & ((share_2 == 0) | (self.guess[0] != self.guess[1]))
        share_1 = ((SCALE - share_2) * self.known[0] >> SCALE_BITS) * apart
        return share_1, share_2

    def update(self, n: int, ids: np.ndarray, choice: np.ndarray, share_1) -> None:
        """choice: 2 or 1 for the order that was right, 0 if neither was."""
        for k, asked in ((1, None), (0, (choice != 2) & (share_1 > 0))):
            right = self.guess[k] == ids
            moved = self.known[k] + ((right * (SCALE - 64) + 32 - self.known[k]) >> RATE)
            if asked is not None:
                moved = np.where(asked, moved, self.known[k])
            self.share[k][self.spot[k]] = moved
            level = self.level[k]
            fresh = ~right & (level <= 1)
            level = np.where(right, np.minimum(level + 1, SURE - 1), np.where(fresh, 1, level >> 1))
            self.table[k][self.at[k]] = np.where(fresh, ids, self.guess[k]) << 3 | level
        missed = np.flatnonzero(choice == 0)
        self.counts[self.rows[missed] + (ids[missed] >> 8)] += 1
        self.last[1][:n] = self.last[0][:n]
        self.last[0][:n] = ids

    def interval(self, rows: np.ndarray, high: np.ndarray):
        at = rows * self.width + high
        begin = self.bounds.take(at)
        return begin, self.bounds.take(at + 1) - begin

    def totals(self, rows: np.ndarray) -> np.ndarray:
        return self.bounds.take((rows + 1) * self.width - 1)


class Coder:
    """Interval states of many blocks, and their bytes as 16-bit words."""

    def __init__(self, words: np.ndarray, reading: bool):
        blocks = len(words)
        self.low, self.size = np.zeros(blocks, np.int64), np.full(blocks, MASK, np.int64)
        self.words, self.wide, self.reading = words.ravel(), words.shape[1], reading
        self.begin = np.arange(blocks) * self.wide
        self.at = np.zeros(blocks, np.int64)
        if reading:                            # 56 bits: three words and half of the fourth
            head = words[:, :4].astype(np.int64)
            self.code = head[:, 0] << 40 | head[:, 1] << 24 | head[:, 2] << 8 | head[:, 3] >> 8
            self.at += 3

    def _next(self, rows: np.ndarray) -> np.ndarray:
        """The 16 bits that follow, half a word on."""
        at = self.begin[rows] + np.minimum(self.at[rows], self.wide - 2)
        self.at[rows] += 1
        pair = self.words.take(at).astype(np.int64) << 16 | self.words.take(at + 1)
        return pair >> 8 & 0xFFFF

    def choose(self, n: int, begin: np.ndarray, width: np.ndarray) -> None:
        step = self.size[:n] >> SCALE_BITS
        self.low[:n] += begin * step
        self.size[:n] = width * step

    def narrow(self, rows, begin, width, total) -> None:
        step = self.size[rows] // total
        self.low[rows] += begin * step
        self.size[rows] = width * step

    def value(self, rows, total) -> np.ndarray:
        step = self.size[rows] // total
        return np.minimum((self.code[rows] - self.low[rows]) // step, total - 1)

    def settle(self, n: int) -> None:
        low, size = self.low[:n], self.size[:n]
        rows = np.flatnonzero(((low ^ (low + size)) < TOP) | (size < BOTTOM))
        while len(rows):
            low, size = self.low[rows], self.size[rows]
            settled = (low ^ (low + size)) < TOP
            size = np.where(settled, size, -low & (BOTTOM - 1))
            if self.reading:
                self.code[rows] = (self.code[rows] << 16 & MASK) | self._next(rows)
            else:
                self.words[self.begin[rows] + self.at[rows]] = low >> 40
                self.at[rows] += 1
            low, size = low << 16 & MASK, size << 16 & MASK
            self.low[rows], self.size[rows] = low, size
            rows = rows[((low ^ (low + size)) < TOP) | (size < BOTTOM)]

    def finish(self) -> None:
        for shift in (40, 24, 8, -8):
            part = self.low >> shift if shift > 0 else self.low << -shift
            self.words[self.begin + self.at] = part & 0xFFFF
            self.at += 1


def _choices(choice, share_1, share_2):
    """Begin and width of each choice's interval: order 2, order 1, neither."""
    rest = SCALE - share_1 - share_2
    begin = np.where(choice == 2, 0, share_2 + np.where(choice == 1, 0, share_1))
    return begin, np.where(choice == 2, share_2, np.where(choice == 1, share_1, rest))


def _sizes(n: int, block: int) -> np.ndarray:
    return np.array([block] * (n // block) + [n % block] * (n % block > 0), np.int64)


def encode(ids: np.ndarray, vocabulary: int, block: int = BLOCK_IDS) -> bytes:
    """The payload of a sequence of ids below ``vocabulary``; may be empty."""
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("an id is not below the size of the vocabulary")
    sizes = _sizes(len(ids), block)
    blocks, high = len(sizes), (max(vocabulary, 1) - 1 >> 8) + 1
    if not blocks:
        return MAGIC + struct.pack("<II", 0, high)
    grid = np.zeros((blocks, block), np.int64)
    grid.ravel()[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)                   # a step is a row
    coder = Coder(np.zeros((blocks, 2 * block + 8), np.uint16), reading=False)
    models = Models(blocks, high)
    for k in range(int(sizes[0])):
        n = blocks if k < sizes[-1] else blocks - 1
        if k % REFRESH == 0 and k:
            models.refresh()
        now = grid[k, :n]
        share_1, share_2 = models.predict(n)
        choice = np.where((share_2 > 0) & (models.guess[1] == now), 2,
                          (share_1 > 0) & (models.guess[0] == now))
        coder.choose(n, *_choices(choice, share_1, share_2))
        missed = np.flatnonzero(choice == 0)
        if len(missed):
            x = now[missed]
            coder.narrow(missed, *models.interval(missed, x >> 8), models.totals(missed))
            coder.narrow(missed, x & 255, 1, 256)
        coder.settle(n)
        models.update(n, now, choice, share_1)
    coder.finish()
    small = np.ascontiguousarray(grid.T).astype("<u4")
    words = coder.words.reshape(blocks, -1).astype("<u2")
    head = [(int(s), 2 * int(coder.at[i]), zlib.crc32(small[i, :s].tobytes()))
            for i, s in enumerate(sizes)]
    return b"".join([MAGIC, struct.pack("<II", blocks, high),
                     *(struct.pack("<III", *h) for h in head),
                     *(words[i, :coder.at[i]].tobytes() for i in range(blocks))])


def decode(payload: bytes) -> np.ndarray:
    """The ids of a payload; ``Damaged`` if a block does not match its checksum."""
    if payload[:4] != MAGIC:
        raise Damaged("not a payload of coded ids")
    blocks, high = struct.unpack_from("<II", payload, 4)
    head = np.frombuffer(payload, "<u4", 3 * blocks, 12).reshape(-1, 3).astype(np.int64)
    if not blocks:
        return np.zeros(0, np.uint32)
    sizes, lengths = head[:, 0], head[:, 1]
    begin = 12 + 12 * blocks + np.concatenate(([0], np.cumsum(lengths)))
    words = np.zeros((blocks, int(lengths.max()) // 2 + 8), np.uint16)
    for i in range(blocks):
        part = np.frombuffer(payload, "<u2", int(lengths[i]) // 2, int(begin[i]))
        words[i, :len(part)] = part
    coder, models = Coder(words, reading=True), Models(blocks, high)
    grid = np.zeros((int(sizes[0]), blocks), np.int64)
    for k in range(int(sizes[0])):
        n = blocks if k < sizes[-1] else blocks - 1
        if k % REFRESH == 0 and k:
            models.refresh()
        share_1, share_2 = models.predict(n)
        v = (coder.code[:n] - coder.low[:n]) // (coder.size[:n] >> SCALE_BITS)
        if v.min() < 0 or v.max() >= SCALE:
            raise Damaged("a block's bytes lead outside its intervals")
        choice = np.where(v < share_2, 2, v < share_2 + share_1)
        coder.choose(n, *_choices(choice, share_1, share_2))
        now = np.where(choice == 2, models.guess[1], models.guess[0])
        missed = np.flatnonzero(choice == 0)
        if len(missed):
            total = models.totals(missed)
            v = coder.value(missed, total)
            at = missed * models.width
            lo, step = np.zeros(len(missed), np.int64), 1 << (high.bit_length() - 1)
            while step:
                up = lo + step
                inside = up < high
                lo = np.where(inside & (models.bounds.take(
                    at + np.where(inside, up, 0)) <= v), up, lo)
                step >>= 1
            coder.narrow(missed, *models.interval(missed, lo), total)
            low = coder.value(missed, 256)
            coder.narrow(missed, low, 1, 256)
            now[missed] = lo << 8 | low
        coder.settle(n)
        grid[k, :n] = now
        models.update(n, now, choice, share_1)
    grid = np.ascontiguousarray(grid.T)
    small = grid.astype("<u4")
    for i in range(blocks):
        if zlib.crc32(small[i, :sizes[i]].tobytes()) != head[i, 2]:
            raise Damaged(f"block {i} does not match its checksum")
    return np.concatenate([small[i, :sizes[i]] for i in range(blocks)]).astype(np.uint32)

"""Quality rules: lines labelled content or boilerplate by a linear-chain CRF.

A document is the sequence of its lines that have words. Each line has a few measures
in 0 to 1; a two-state chain with one weight per state and measure, start weights and
transition weights is fitted to labelled documents, whose lines take the document's
label, by gradient ascent on the conditional likelihood. Viterbi decoding marks every
line of every document; the share of words in content lines decides, after fixed
rules on the whole text. The fit uses a bounded sample (``SAMPLE`` documents); all
else covers all rows, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchlight.llm.common import keyed_text, slices, starts_of, utf8
from merchlight.llm.words import BASE, BASE_INVERSE, BYTE_VALUES, U64, mix, powers, words_of

#: Labelled documents that a chain is fitted on, at most.
SAMPLE = 3000
#: Lines of a training sequence, and passes over them.
WINDOW, PASSES = 32, 200
#: Share of words in content lines that a kept document has at least.
CONTENT = 0.5
MEASURES = ("one", "symbols", "bars", "capitals", "shouts", "stutter", "copied", "recurring",
            "digits", "length", "wordiness")

_CLASS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "symbols": b"#*$%&|<>", "bars": b"|", "shouts": b"!", "digits": b"0123456789",
    "capitals": bytes(range(65, 91))}.items()}
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


@dataclass
class Chain:
    """weights: state x measure; start: by state; step: from state x to state.

    State 0 is boilerplate, 1 content.
    """

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray


@dataclass
class Lines:
    """Measures of the lines of several texts; ``first`` says whose."""

    words: np.ndarray
    measures: np.ndarray
    first: np.ndarray


def quality(docs: DataFrame, chain: Chain | None, *, id_col: str = "doc_id",
            text_col: str = "text", content: float = CONTENT) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, content_share``.

    Null and empty texts have no words, fail the base rules and have share 0. Without
    a chain every line is content. Repeated rows and rows without id are judged like
    others; other columns are ignored; an empty table gives an empty result.
    """
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in slices(texts):
                counts, lines = measured(texts[lo:hi])
                good = viterbi(lines, chain) if chain else np.ones(len(lines.words), bool)
                sums = np.concatenate(([0], np.cumsum(lines.words * good)))[lines.first]
                n = counts["n_words"]
                share = np.diff(sums) / np.maximum(n, 1)
                failed = (n < 50) | (100 * counts["n_repeat_words"] > 50 * n)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), *map(pa.array, counts.values()),
                     pa.array(failed), pa.array(~failed & (share >= content)), pa.array(share)],
                    names=["doc_id", *counts, "base_failed", "kept", "content_share"])

    return keyed_text(docs, id_col, text_col).mapInArrow(
        judged, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                "n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def learn_chain(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
                text_col: str = "text", sample: int = SAMPLE) -> Chain | None:
    """Fit a chain to at most ``sample`` labelled documents, taken by a hash of the id.

    Null labels do not count. None if one of the two labels is missing.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL") \
        .groupBy("doc_id").agg(F.min("quality").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = keyed_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id") \
        .select("text", "quality")

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(0))
            quality = np.asarray(batch.column(1))
            for lo, hi in slices(texts):
                _, lines = measured(texts[lo:hi])
                for i in range(hi - lo):
                    own = lines.measures[lines.first[i]:lines.first[i + 1]]
                    parts = [own[k:k + WINDOW] for k in range(0, len(own), WINDOW)]
                    if parts:
                        yield pa.record_batch(
                            [pa.array([int(quality[lo + i])] * len(parts), pa.int32()),
                             pa.array([p.ravel().tolist() for p in parts])],
                            names=["quality", "measures"])

    got = rows.mapInArrow(lines_of, "quality int, measures array<double>").collect()
    got.sort(key=lambda r: (r["quality"], r["measures"]))
    return fit([np.array(r["measures"]).reshape(-1, len(MEASURES)) for r in got],
               np.array([r["quality"] for r in got], int))


def measured(texts: list[bytes]) -> tuple[dict[str, np.ndarray], Lines]:
    """Whole-text counts of each text, and the measures of its lines with words."""
    words = words_of(texts, lower=False)
    raw, n_words = words.bytes, words.counts()
    doc = np.repeat(np.arange(len(texts)), n_words)
    total = {name: np.concatenate(([0], np.cumsum(hit[raw]))) for name, hit in _CLASS.items()}
    in_text = lambda c: c[words.offset[1:]] - c[words.offset[:-1]]
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    point_sums = np.concatenate(([0], np.cumsum(points[words.end] - points[words.begin])))

    begin = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    line_doc = np.searchsorted(words.offset, begin[:-1], side="right") - 1
    line = np.searchsorted(begin, words.begin, side="right") - 1
    used, first_word, per_line = np.unique(line, return_index=True, return_counts=True)
    a, b = begin[used], begin[used + 1] - 1
    owner = line_doc[used]
    copied = _seen_before(owner, _span_hashes(raw, a, b))

    again = np.zeros(len(doc), bool)
    if len(doc) > 2:
        h = words.hash
        window = mix((h[:-2] * U64(BASE) + h[1:-1]) * U64(BASE) + h[2:])
        whole = doc[:-2] == doc[2:]
        key = mix(window + doc[:-2].astype(U64) * U64(0xA0761D6478BD642F))
        _, which, count = np.unique(key[whole], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(whole)[count[which] > 1]
        for k in range(3):
            again[twice + k] = True
    same = np.concatenate(([False], (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])))
    in_words = lambda flag: np.add.reduceat(flag.astype(np.int64), first_word) if len(used) \
        else np.zeros(0)
    counts = {"n_words": n_words,
              "word_chars": point_sums[words.first[1:]] - point_sums[words.first[:-1]],
              "n_symbols": in_text(total["symbols"]),
              "n_dup_lines": np.bincount(owner[copied], minlength=len(texts)),
              "n_repeat_words": np.bincount(doc[again], minlength=len(texts))}

    inside = lambda name: total[name][b] - total[name][a]
    letter_sum = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    letters = np.maximum(letter_sum[b] - letter_sum[a], 1)
    measures = np.stack([
        np.ones(len(used)), inside("symbols") / per_line, inside("bars") / per_line,
        inside("capitals") / letters, inside("shouts") / per_line, in_words(same) / per_line,
        copied, in_words(again) / per_line, inside("digits") / letters,
        np.log2(per_line + 1) / 8, (b - a) / per_line / 16,
    ], axis=1).clip(0, 1)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return counts, Lines(per_line, measures, first)


def _span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    summed = np.zeros(raw.size + 1, U64)
    np.cumsum(BYTE_VALUES[raw] * powers(BASE, max(raw.size, 1))[:raw.size], out=summed[1:])
    span = (summed[end] - summed[begin]) * powers(BASE_INVERSE, max(raw.size, 1))[begin]
    return mix(span + (end - begin).astype(U64))


def _seen_before(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an earlier element of the same group has the same value."""
    order = np.lexsort((np.arange(len(value)), value, group))
    out = np.zeros(len(value), bool)
    out[order[1:]] = (value[order][1:] == value[order][:-1]) & \
        (group[order][1:] == group[order][:-1])
    return out


def viterbi(lines: Lines, chain: Chain) -> np.ndarray:
    """Whether each line is content on the best path of its text; ties go to content.

    All texts move one line at a time together, the long ones at the end alone.
    """
    score = lines.measures @ chain.weights.T
    size = np.diff(lines.first)
    texts = np.argsort(-size, kind="stable")
    texts = texts[size[texts] > 0]
    if not len(texts):
        return np.zeros(0, bool)
    active = len(texts) - np.searchsorted(size[texts][::-1], np.arange(size[texts[0]]), "right")
    best = chain.start + score[lines.first[texts]]
    back = np.zeros((len(score), 2), np.int8)
    for k in range(1, len(active)):
        at = lines.first[texts[:active[k]]] + k
        from_0 = best[:active[k], :1] + chain.step[0]
        from_1 = best[:active[k], 1:] + chain.step[1]
        back[at] = from_1 >= from_0
        best[:active[k]] = np.maximum(from_0, from_1) + score[at]
    state = (best[:, 1] >= best[:, 0]).astype(np.int8)
    out = np.zeros(len(score), bool)
    for k in range(len(active) - 1, -1, -1):
        at = lines.first[texts[:active[k]]] + k
        now = state[:active[k]]
        out[at] = now
        state[:active[k]] = back[at, now]
    return out


def fit(sequences: list[np.ndarray], label: np.ndarray, passes: int = PASSES) -> Chain | None:
    """Weights of the highest penalised conditional likelihood, by gradient ascent."""
    if len(set(label.tolist())) < 2:
        return None
    n, width = len(sequences), sequences[0].shape[1]
    size = np.array([len(s) for s in sequences])
    longest = size.max()
    x = np.zeros((n, longest, width))
    for i, s in enumerate(sequences):
        x[i, :len(s)] = s
    mask = np.arange(longest) < size[:, None]
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / (label == 0).sum())
    share = share / size                                   # both labels weigh the same
    truth = np.zeros((n, longest, 2))
    truth[np.arange(n), :, label] = 1
    theta = [np.zeros((2, width)), np.zeros(2), np.zeros((2, 2))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for t in range(1, passes + 1):
        state, moves = _marginals(x @ theta[0].T, mask, theta[1], theta[2])
        off = (truth - state) * mask[..., None] * share[:, None, None]
        real = np.zeros((2, 2))
        for y in (0, 1):
            real[y, y] = ((size - 1) * share)[label == y].sum()
        grads = [np.einsum("nts,ntf->sf", off, x), off[:, 0].sum(axis=0),
                 real - (moves * share[:, None, None]).sum(axis=0)]
        for k, g in enumerate(grads):
            g = g - 1e-4 * theta[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            theta[k] = theta[k] + 0.1 * (first[k] / (1 - 0.9 ** t)) / (
                np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-8)
    return Chain(*theta)


def _marginals(score, mask, start, step):
    """State probabilities of every line, and summed probabilities of every move."""
    n, longest, _ = score.shape
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = start + score[:, 0]
    for k in range(1, longest):
        now = np.logaddexp(ahead[:, k - 1, :1] + step[0], ahead[:, k - 1, 1:] + step[1])
        ahead[:, k] = np.where(mask[:, k, None], now + score[:, k], ahead[:, k - 1])
    moves = np.zeros((n, 2, 2))
    whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
    for k in range(longest - 1, 0, -1):
        onward = score[:, k] + behind[:, k]
        joint = ahead[:, k - 1, :, None] + step + onward[:, None, :]
        moves += np.exp(joint - whole[:, :, None]) * mask[:, k, None, None]
        before = np.logaddexp(step[:, 0] + onward[:, :1], step[:, 1] + onward[:, 1:])
        behind[:, k - 1] = np.where(mask[:, k, None], before, 0)
    return np.exp(ahead + behind - whole[:, :, None]) * mask[..., None], moves


def keep_good(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document is kept.

    The judgement depends on the text alone, so rows are matched by id; a row without
    id cannot be matched and stays.
    """
    gone = quality(docs, chain, id_col=id_col).where("NOT kept AND doc_id IS NOT NULL") \
        .select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)

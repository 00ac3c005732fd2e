"""Substring dedup of words with a compressed FM-index in each shard.

A window is WINDOW (20) consecutive words of one document. Each word covered by a window whose words also start earlier (in a smaller
doc_id, or earlier in the same document) is removed; windows are judged on the input. repeats.py brings all text that may be equal
together in shards. A shard's distinct contexts are joined, each behind a separator, and indexed: the suffix array gives the
Burrows-Wheeler transform, which is kept as a wavelet matrix of bit vectors with block counts (about 1.5 bits a bit of the alphabet);
of the suffix array itself only every SAMPLE-th place stays, others are found by walking back to one.

Contexts are then streamed against the index: backward search from each place, all abreast, gives its matching statistic, the length
of the longest string ending there that stands at several places of the corpus (to the window's length). Where it reaches the window,
the interval of suffixes is reported, its rows are located, and the smallest place among them is that of the window.

Nulls and odd inputs: null text has no words. Rows with one doc_id count as one document, and windows at one start in them don't remove
each other. A null doc_id counts as the largest. Documents under 20 words stay whole. Empty tables work. Columns of docs other than
doc_id and text are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Batch, Plan, removed

WINDOW, GRAM, SAMPLE = 20, 8, 8
#: The bits below each of 64.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with rank: 64-bit words and the count before each."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))])[:-1].astype(np.uint32)
        self.ones = int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each of the places."""
        w = i >> 6
        return np.bitwise_count(self.words[w] & BELOW[i & 63]) + self.before[w].astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: access to and rank of symbols in a sequence."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for d in range(self.depth - 1, -1, -1):
            bit = (seq >> d) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(len(seq) - self.levels[-1].ones)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.first = self._begin(np.arange(sigma))

    def _begin(self, c: np.ndarray) -> np.ndarray:
        """Where each symbol's run begins on the last level."""
        at = np.zeros(len(c), np.int64)
        for bits, zeros, d in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1)):
            ones = bits.rank1(at)
            at = np.where((c >> d) & 1, zeros + ones, at - ones)
        return at

    def symbol(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some places, and how often each comes before."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(i), bits.rank1(i)
            i = np.where(one, zeros + ones, i - ones)
            c = 2 * c + one
        return c, i - self.first[c]

    def ranks(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often c comes before lo and before hi."""
        both, c2 = np.concatenate([lo, hi]), np.concatenate([c, c])
        for bits, zeros, d in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1)):
            ones = bits.rank1(both)
            both = np.where((c2 >> d) & 1, zeros + ones, both - ones)
        both -= self.first[c2]
        return both[: len(c)], both[len(c) :]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling."""
    rank, size = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    n = len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - size, 0)] = rank[size:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key)
        key = key[order]
        new = np.cumsum(np.append(0, key[1:] != key[:-1]))
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        size *= 2


class FMIndex:
    """weight: how much each place of the text counts when a string's occurrences are."""

    def __init__(self, text: np.ndarray, weight: np.ndarray | None = None):
        sa = suffix_array(text)
        self.n, sigma = len(text), int(text.max()) + 1
        self.wavelet = Wavelet(text[sa - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.weights = np.concatenate([[0], np.cumsum(np.ones(len(text), np.int64) if weight is None else weight[sa])])
        self.marked = Bits((sa % SAMPLE == 0).astype(np.uint8))
        self.samples = sa[sa % SAMPLE == 0].astype(np.uint32)

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns with one more symbol in front."""
        a, b = self.wavelet.ranks(c, lo, hi)
        return self.less[c] + a, self.less[c] + b

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of some rows of the suffix array."""
        out, steps, todo, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(todo):
            known = self.marked.get(at)
            out[todo[known]] = self.samples[self.marked.rank1(at[known])].astype(np.int64) + steps
            todo, at = todo[~known], at[~known]
            c, before = self.wavelet.symbol(at)
            at, steps = self.less[c] + before, steps + 1
        return out

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, to a length of most: for each end in text the length of the longest string before it with a weight
        of two or more, and the interval of those that reach most (elsewhere 0, 0)."""
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for k in range(1, most + 1):
            c = text[ends[live] - k]
            lo, hi = self.step(c, lo, hi) if k > 1 else (self.less[c], self.less[c + 1])  # all suffixes that begin with it
            more = self.weights[hi] - self.weights[lo] > 1
            live, lo, hi = live[more], lo[more], hi[more]
            length[live] = k
        first, behind = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        first[live], behind[live] = lo, hi
        return length, first, behind


def engine(contexts: list[bytes], n: np.ndarray, place: np.ndarray, weight: np.ndarray, plan: Plan) -> np.ndarray:
    """The smallest place of each window of contexts that stands at several, else a large number. weight: at how many places each
    context stands."""
    words = [w for c in contexts for w in (b"", *c.split())]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}  # the separator, which comes first, is 0
    text = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    del words, ids
    begin = np.flatnonzero(text == 0) + 1
    sizes = n + plan.window  # with the separator
    index = FMIndex(text, np.repeat(weight, sizes))
    owner = np.repeat(np.arange(len(contexts)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + within
    out = np.full(len(at), np.iinfo(np.int64).max)
    length, lo, hi = index.matching(text, at + plan.window, plan.window)
    found = length == plan.window
    if not found.any():
        return out
    # equal windows have one interval: each is located once, and its smallest place taken
    left, one, back = np.unique(lo[found], return_index=True, return_inverse=True)
    right = hi[found][one]
    reps = right - left
    rows = np.repeat(left - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
    where = index.locate(rows)
    context = np.searchsorted(begin, where, side="right") - 1
    least = np.minimum.reduceat(place[context] + (where - begin[context]) * plan.key_start, np.cumsum(reps) - reps)
    out[found] = least[back]
    return out


def finish(b: Batch, i: int, gone: np.ndarray) -> dict:
    words = b.words[i]
    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return {"n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": edges.astype("<i8").tobytes(), "kept": kept.decode()}


def _digest(b: Batch, i: int, gone: np.ndarray) -> dict:
    out = finish(b, i, gone)
    return {k: out[k] for k in ("n_words", "n_removed", "kept_sha256")}


def dedup_words(docs: DataFrame, digest_only: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; and, unless digest_only, spans (pairs of little-endian 64-bit word numbers, start and
    end, as binary) and kept (the words that stay, joined by blanks)."""
    plan = Plan(True, WINDOW, GRAM, True, 4 << 20, engine, _digest if digest_only else finish)
    return removed(docs, plan, "n_words long, n_removed long, kept_sha256 string" + ("" if digest_only else ", spans binary, kept string"))

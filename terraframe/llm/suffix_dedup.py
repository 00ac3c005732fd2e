"""Suffix-array dedup of byte strings: a logarithmic family of suffix arrays in each shard.

Of every byte string of WINDOW bytes (50) that also starts in a document with a smaller doc_id, all bytes are removed; windows are
judged on the input. repeats.py brings all text that may be equal together in shards; contexts come in order of doc_id and are taken
in batches. A batch's suffixes (those at which a window starts) are sorted to the window's length into a suffix array, which is
merge-scanned against each existing level for matches of a whole window: both are sorted, so each search goes on from where the last
one ended. Then the batch becomes a level, and levels of about equal size are merged, so that a shard of n suffixes has about
log2(n / INDEX_BATCH) levels, and each suffix is merged as often. A level is its text and the places of suffixes in it, in order; of
suffixes with equal windows the one with the smallest document stays.

Suffixes are kept only where repeats.py found a gram that occurs elsewhere: any other can have no match.

Nulls and odd inputs: null text is empty. Rows with one doc_id don't remove from each other; what a smaller doc_id holds goes from all
of them. A null doc_id counts as the largest. Documents under 50 bytes stay whole. Empty tables work. Columns of docs other than
doc_id and text are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Batch, Plan, removed

WINDOW, GRAM = 50, 20
INDEX_BATCH = 1 << 16


def windows_at(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The depth bytes at each place, as strings that compare."""
    rows = np.lib.stride_tricks.sliding_window_view(text, depth)[at]
    return np.ascontiguousarray(rows).view(f"S{depth}").ravel()


class Level:
    """A suffix array to the depth of a window: the text, the places of its distinct windows in their order (sa), and the smallest
    place in the corpus of each."""

    def __init__(self, text: np.ndarray, sa: np.ndarray, least: np.ndarray, depth: int):
        self.text, self.sa, self.least, self.depth = text, sa, least, depth

    def windows(self) -> np.ndarray:
        return windows_at(self.text, self.sa, self.depth)

    @classmethod
    def of(cls, text: np.ndarray, at: np.ndarray, place: np.ndarray, depth: int) -> tuple[Level, np.ndarray]:
        """The level of suffixes at some places of a text; and for each of them its number in it."""
        w = windows_at(text, at, depth)
        order = np.argsort(w, kind="stable")
        w = w[order]
        new = np.append(True, w[1:] != w[:-1])[: len(w)]
        number = np.empty(len(w), np.int64)
        number[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return cls(text, at[order][first], np.minimum.reduceat(place[order], first) if len(first) else place, depth), number

    def scan(self, windows: np.ndarray) -> np.ndarray:
        """For windows in order, the smallest place here of each; a large number if none is equal."""
        own = self.windows()
        at = np.searchsorted(own, windows)
        at[at == len(own)] = 0
        return np.where(own[at] == windows, self.least[at], np.iinfo(np.int64).max)

    def merged(self, other: Level) -> Level:
        """Both as one: a merge of their two orders."""
        text = np.concatenate([self.text, other.text])
        sa = np.concatenate([self.sa, other.sa + len(self.text)])
        w = np.concatenate([self.windows(), other.windows()])
        order = np.argsort(w, kind="stable")  # two runs in order: a merge
        w = w[order]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        return Level(text, sa[order][first], np.minimum.reduceat(np.concatenate([self.least, other.least])[order], first), self.depth)


class Family:
    """Levels of geometrically growing size."""

    def __init__(self, depth: int = WINDOW):
        self.levels: list[Level] = []
        self.depth = depth

    def add(self, text: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Takes a batch: the suffixes at some places of a text, with their places in the corpus. Gives, for each of them, the smallest
        place of an equal window so far."""
        new, number = Level.of(text, at, place, self.depth)
        windows, least = new.windows(), new.least.copy()
        for level in self.levels:
            np.minimum(least, level.scan(windows), out=least)
        while self.levels and len(self.levels[-1].sa) < 2 * len(new.sa):
            new = self.levels.pop().merged(new)
        self.levels.append(new)
        return least[number]


def engine(contexts: list[bytes], n: np.ndarray, place: np.ndarray, weight: np.ndarray, plan: Plan) -> np.ndarray:
    """The smallest place of each window of contexts; they come by place, so a window's smallest place is known when it is added."""
    family, out = Family(plan.window), []
    last = np.cumsum(n)
    i = 0
    while i < len(contexts):
        j = max(i + 1, int(np.searchsorted(last, (last[i - 1] if i else 0) + INDEX_BATCH, side="right")))
        text = np.frombuffer(b"".join(contexts[i:j]), np.uint8)
        sizes = n[i:j] + plan.window - 1
        within = np.arange(n[i:j].sum()) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        at = np.repeat(np.cumsum(sizes) - sizes, n[i:j]) + within
        out.append(family.add(text, at, np.repeat(place[i:j], n[i:j]) + within * plan.key_start))
        i = j
    return np.concatenate(out)


def finish(b: Batch, i: int, gone: np.ndarray) -> dict:
    raw = b.raw[i]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(edges) else raw
    spans = edges.astype("<i8").tobytes()
    return {"n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": len(edges) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": spans, "kept": kept}


def _digest(b: Batch, i: int, gone: np.ndarray) -> dict:
    out = finish(b, i, gone)
    return {k: out[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}


def dedup_bytes(docs: DataFrame, digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; and, unless digest_only, spans (pairs of little-endian 64-bit start and end,
    as binary) and kept (the bytes that stay)."""
    plan = Plan(False, WINDOW, GRAM, False, 2 << 20, engine, _digest if digest_only else finish)
    return removed(docs, plan, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ("" if digest_only else ", spans binary, kept binary"))

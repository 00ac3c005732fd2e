"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, one scan of each text.

Texts and items are normalised alike: A-Z lowered, every other ASCII character but digits and letters taken as a gap. The windows of all
items (eight words; a shorter item whole) are the automaton's patterns. A word of theirs is spelt by a fixed number of letters of a small
alphabet, the first of which no other place has, and any other word by as many blanks; so a match is one of whole words, its place
gives word numbers, and as normalisation keeps the order of words, these give offsets in the original text.

The windows are found by Spark, written to the shared folder and read by the workers, each of which makes the automaton once. Its memory
is about 1.5 KB a window, so more than max_windows of them (300 MB by default) are refused with an error: give workers more memory and
raise it. Nothing else depends on the size of the benchmark.

Nulls and odd inputs: a null text or item has no words; an item without words is never found. Items with one item_id count
as one item; windows of items with a null item_id count as hits, but aren't reported in items. Rows with one doc_id are each judged for
themselves. Empty tables work. Other columns pass through; of columns named as the results are, the results' win.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER, fs_of, shared_dir, slices, table, use_repo

MAX_WINDOWS = 200_000
_FIRST, _REST = [[chr(c) for c in range(c, c + 64)] for c in (128, 192)]
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAPS = bytes(c if WORD.match(bytes([c])) else 32 for c in LOWER)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULTS = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": SPANS}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_GAPS).split()


def windows(text: str | None, size: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _cut(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(window, item_id) of each item."""
    for b in it:
        rows = [(w.decode(), None if i is None else str(i)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in windows(t, size)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([i for _, i in rows], pa.string())], names=["window", "item"])


@dataclass
class Patterns:
    """The automaton, and how words are spelt for it. A match gives (words, item ids)."""

    spelt: dict[bytes, str]
    width: int
    automaton: ahocorasick.Automaton

    @classmethod
    def of(cls, pairs: list[tuple[str, str | None]]) -> Patterns | None:
        items: dict[str, list[str]] = {}
        for w, i in pairs:
            own = items.setdefault(w, [])
            if i is not None and i not in own:
                own.append(i)
        if not items:
            return None
        vocabulary = sorted({w for x in items for w in x.split(" ")})
        width = 1
        while 64**width < len(vocabulary):
            width += 1
        digits = lambda n: [n // 64**k % 64 for k in range(width)]
        spelt = {w.encode(): "".join((_REST if k else _FIRST)[d] for k, d in enumerate(digits(n))) for n, w in enumerate(vocabulary)}
        a = ahocorasick.Automaton()
        for w, own in items.items():
            parts = w.encode().split(b" ")
            a.add_word("".join(spelt[x] for x in parts), (len(parts), own))
        a.make_automaton()
        return cls(spelt, width, a)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str], int]:
        """Number of words, merged runs [first, end) of hit words, items found, words of the longest window found."""
        words = words_of(text)
        blank = " " * self.width
        get = self.spelt.get
        runs, items, longest = [], set(), 0
        for end, (n, own) in self.automaton.iter("".join([get(w, blank) for w in words])):
            last = (end + 1) // self.width
            runs.append((last - n, last))
            items.update(own)
            longest = max(longest, n)
        return len(words), join_runs(runs), items, longest


def join_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(runs)):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


@lru_cache(1)
def patterns(uri: str) -> Patterns | None:
    """Of a table (window, item) in the shared folder; a worker keeps the last."""
    fs, path = fs_of(uri)
    t = pq.read_table(path, filesystem=fs, columns=["window", "item"])
    return Patterns.of(sorted(zip(t["window"].to_pylist(), t["item"].to_pylist()), key=str))


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of runs of words."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(LOWER))]
    chars = lambda b: len(raw[:b].decode())
    return [(chars(at[a][0]), chars(at[b - 1][1])) for a, b in runs]


def _scan(it: Iterator[pa.RecordBatch], schema: pa.Schema, uri: str, with_spans: bool, runs_only: bool) -> Iterator[pa.RecordBatch]:
    p = patterns(uri)
    for b in slices(it):
        texts = b.column("text").to_pylist()
        rows = [p.hits(t) if p else (len(words_of(t)), [], set(), 0) for t in texts]
        new = {
            "n_words": [n for n, *_ in rows], "n_hit": [sum(e - s for s, e in r) for _, r, *_ in rows], "items": [sorted(x) for _, _, x, _ in rows], "longest": [x for *_, x in rows],
            "spans": [[{"start": s, "end": e} for s, e in (r if runs_only else offsets(t, r) if r and with_spans else [])] for (_, r, *_), t in zip(rows, texts)],
        }
        yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else b.column(f.name).cast(f.type) for f in schema], schema=schema)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = 8, with_spans: bool = True, runs_only: bool = False, longest: bool = False, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, items (ids with an occurring window, sorted as strings) and spans (offsets of hit runs in the
    original text, in code points; with runs_only, numbers of words instead); with longest, also the words of the longest window held.
    See the module for the method and for nulls and ties."""
    spark = docs.sparkSession
    use_repo(spark)
    results = RESULTS | ({"longest": T.LongType()} if longest else {})
    base = docs.select(*[c for c in docs.columns if c not in results])
    folder = shared_dir(spark)
    pairs = benchmark.select("item_id", "text").mapInArrow(lambda it: _cut(it, size), "window string, item string").distinct()
    found = table(pairs, "windows", folder).count()
    if found > max_windows:
        raise ValueError(f"the benchmark has {found} windows, of which max_windows allows {max_windows}; each takes about 1.5 KB of a worker's memory")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.schema] + [T.StructField(n, t) for n, t in results.items()])
    arrow = to_arrow_schema(schema)
    return base.mapInArrow(lambda it: _scan(it, arrow, f"{folder}/windows", with_spans, runs_only), schema)

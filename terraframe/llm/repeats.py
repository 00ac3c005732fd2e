"""Exact repeated windows over a whole corpus: the distributed part that suffix-array dedup and FM-index dedup share.

A window is WINDOW consecutive symbols (bytes or words) of one document. Every window has an anchor, the leftmost of the smallest
gram hashes in it, so equal windows have equal anchors at equal places, and an anchor's windows form one context of text. That makes
the anchor's gram the key by which the corpus is split into shards: all windows that could be equal meet in one shard. Hashes only
tell where text goes; which windows are equal is found by the engines on the text itself.

1. Documents are gathered into batches, written to the shared folder; each sends the distinct gram hashes of its anchors, sorted and
   delta-coded, to shards by hash range (about 5 bytes an anchor). Batches of one task travel in groups, a row for each group and
   shard: groups grow with the corpus (to GROUP_BYTES), as there are more shards then and a row a batch would hold ever less.
2. A shard tells each batch which of its grams occur elsewhere too, and which in more than HOT batches (a bit a gram each).
3. A batch reads its file again and sorts the suffixes at which its contexts at repeated grams begin (a sparse suffix array, to the
   context's end). Equal neighbours go to the gram's shard as one record, with the smallest place (document, start) they have in the
   batch and the next larger one. At hot grams, contexts are cut further, by longer grams, which spreads them over shards.
4. A shard hands its distinct contexts and their smallest places to an engine (suffix arrays or an FM-index), which gives the smallest
   place of each window. Windows of a record at a larger place are repeats. Results go back as runs of window numbers.
5. A batch marks what its repeated windows cover and gives its rows.

Batches bound memory by BATCH_BYTES (a longer document is a batch of its own, scanned in chunks), shards by SHARD_BYTES of text that
they stand for. A passage that any number of documents share reaches a shard once a batch; what a shard holds of it is a record of
about a hundred bytes for each batch that has it. Files carry names made of partition and number and are renamed into place, so a
repeated task writes the same file again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, WordHash, ids, mix, read_file, shared_dir, texts, use_repo, write_file

HASH_BITS = 56
CHUNK = 1 << 19
SHARD_BYTES = 8 << 20
GROUP_BYTES = 16 << 20
#: Text that a group should have for each shard.
ROW_BYTES = 1 << 14
HOT = 512
_ODD = [int(x) for x in mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)]
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Plan:
    """What is sought. key_start: whether an equal window earlier in the same document counts. hot: batches that hold a gram, beyond
    which its contexts are cut by longer grams."""

    words: bool
    window: int
    gram: int
    key_start: bool
    batch_bytes: int
    engine: Callable
    finish: Callable
    hot: int = HOT


# --- coding ----------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(1).compress(struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts))


def unpack(blob: bytes, *types: str) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * len(types)
    for n, t in zip(struct.unpack_from(f"<{len(types)}Q", raw), types):
        out.append(raw[at : at + n] if t == "bytes" else np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def deltas(sorted_values: np.ndarray) -> bytes:
    """Sorted 64-bit values, as differences of as many bytes as the largest takes."""
    if not len(sorted_values):
        return b""
    d = np.diff(sorted_values, prepend=np.uint64(0))
    width = max(1, -(-int(d.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def undelta(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, : data[0]] = raw
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


# --- anchors ---------------------------------------------------------------------------------------


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k symbols, by doubling."""
    out, done, level = None, 0, 0
    cur, size = x, 1
    while k:
        if k & 1:
            if out is None:
                out, done = cur, size
            else:
                n = len(cur) - done
                out = (out[: max(n, 0)] * np.uint64(_ODD[2 * level])) + cur[done:] if n > 0 else np.empty(0, np.uint64)
                out ^= out >> np.uint64(32)
                done += size
        k >>= 1
        if k:
            cur = cur[:-size] * np.uint64(_ODD[2 * level + 1]) + cur[size:] if len(cur) > size else np.empty(0, np.uint64)
            cur ^= cur >> np.uint64(31)
            size, level = 2 * size, level + 1
    return mix(out)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def anchors(symbols: np.ndarray, ends: np.ndarray, plan: Plan) -> dict[str, np.ndarray]:
    """Contexts of a batch: gram (hash, HASH_BITS), lo, n (its windows start at lo .. lo + n - 1).
    symbols: of all documents in a row; ends: where each document ends."""
    w = plan.window - plan.gram + 1
    every = []
    starts = len(symbols) - plan.window + 1
    for c in range(0, max(starts, 0), CHUNK):
        part = symbols[c : min(c + CHUNK, starts) + plan.window - 1]
        x = mix(part) if plan.words else _BYTES[part]
        h = grams(x, plan.gram)
        low = _sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), w)
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s = np.arange(len(at)) + c
        doc = np.searchsorted(ends, s, side="right")
        valid = ends[np.minimum(doc, len(ends) - 1)] - s >= plan.window
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        lo = np.flatnonzero(new & valid)
        stop = np.flatnonzero(valid & np.append((at[1:] != at[:-1]) | ~valid[1:], True))
        every.append((h[at[lo]] >> np.uint64(64 - HASH_BITS), lo + c, stop - lo + 1))
    cols = [np.concatenate(x) for x in zip(*every)] if every else [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
    return dict(zip(("gram", "lo", "n"), cols))


def split(a: dict[str, np.ndarray], hot: np.ndarray, longer: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Contexts a, those that are hot cut where the anchors of longer grams change, with both grams as the key."""
    lo, stop = a["lo"][hot], a["lo"][hot] + a["n"][hot]
    first = np.searchsorted(longer["lo"], lo, side="right") - 1
    reps = np.searchsorted(longer["lo"], stop - 1, side="right") - first
    own = np.repeat(np.arange(len(lo)), reps)
    j = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(reps) - reps, reps)
    begin = np.maximum(lo[own], longer["lo"][j])
    n = np.minimum(stop[own], longer["lo"][j] + longer["n"][j]) - begin
    gram = mix(a["gram"][hot][own] * np.uint64(_ODD[62]) + longer["gram"][j]) >> np.uint64(64 - HASH_BITS)
    return {k: np.concatenate([a[k][~hot], x]) for k, x in (("gram", gram), ("lo", begin), ("n", n))}


class Batch:
    """The documents of one batch file."""

    def __init__(self, doc_ids: np.ndarray, raw: list[bytes], plan: Plan, hashes: WordHash | None = None, hashed: bool = True):
        self.ids, self.raw, self.plan = doc_ids, raw, plan
        if plan.words:
            self.words = [r.split() for r in raw]
            if hashed:
                hashes = WordHash() if hashes is None else hashes
                parts = [hashes.of(x) for x in self.words]
                self.symbols = np.concatenate(parts) if parts else np.empty(0, np.uint64)
                self.flat = [w for x in self.words for w in x]
            sizes = [len(x) for x in self.words]
        else:
            self.bytes = b"".join(raw)
            self.symbols, sizes = np.frombuffer(self.bytes, np.uint8), [len(x) for x in raw]
        self.ends = np.cumsum(sizes, dtype=np.int64) if sizes else np.zeros(0, np.int64)
        self.starts = self.ends - np.array(sizes, np.int64)

    def save(self, uri: str) -> None:
        write_file(uri, pack(self.ids.astype("<i8"), np.array([len(x) for x in self.raw], "<i8"), b"".join(self.raw)))

    @classmethod
    def load(cls, uri: str, plan: Plan, hashed: bool = True) -> Batch:
        doc_ids, sizes, data = unpack(read_file(uri), "<i8", "<i8", "bytes")
        ends = np.cumsum(sizes)
        return cls(doc_ids, [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())], plan, None, hashed)

    def text(self, lo: int, hi: int) -> bytes:
        return b" ".join(self.flat[lo:hi]) if self.plan.words else self.bytes[lo:hi]

    def units(self) -> np.ndarray:
        """The symbols in as few bytes as tell them apart within the batch."""
        if not self.plan.words:
            return self.symbols
        seen = {w: i for i, w in enumerate(dict.fromkeys(self.flat), 1)}
        return np.fromiter(map(seen.__getitem__, self.flat), ">u4", len(self.flat))


def suffixes(b: Batch, lo: np.ndarray, n: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse suffix array of a batch: contexts in order of their text, then length, then place; and which differ from the one
    before."""
    units, width = b.units(), int(n.max(initial=1)) + b.plan.window - 1
    padded = np.concatenate([units, np.zeros(width, units.dtype)]).astype(units.dtype)
    text = np.lib.stride_tricks.sliding_window_view(padded, width)[lo]
    text[np.arange(width) >= (n + b.plan.window - 1)[:, None]] = 0
    text = text.view(f"S{width * units.itemsize}").ravel()
    order = np.lexsort((start, key, n))
    order = order[np.argsort(text[order], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (n[order][1:] != n[order][:-1])
    return order, new


def _distinct(a: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct grams, whether each has several anchors, and the number of each anchor's gram."""
    g, inverse, count = np.unique(a["gram"], return_inverse=True, return_counts=True)
    return g, count > 1, inverse


def _bounds(shards: int) -> np.ndarray:
    return np.array([(i << HASH_BITS) // shards for i in range(shards + 1)], np.uint64)


def _cuts(g: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(g, _bounds(shards))


def _group_bytes(shards: int, batch_bytes: int) -> int:
    return max(batch_bytes, min(GROUP_BYTES, ROW_BYTES * shards))


def _name(part: int, number: int, batches: int) -> str:
    return f"{part:07}-{number:06}-{batches:06}"


def _files(group: str) -> list[str]:
    """The files of a group's batches."""
    head, _, batches = group.rpartition("-")
    return [f"{head}-{i:06}" for i in range(int(batches))]


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first .. first + size - 1 of all pairs, in a row."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _joined(parts: list[np.ndarray], shard: int, shards: int) -> bytes:
    """Sorted grams of a group's batches in one shard (twice the gram, and one if it has several anchors), as one sorted sequence."""
    low, width = _span(shard, shards)
    return deltas(np.concatenate([x - np.uint64(2 * low) + np.uint64(2 * i * width) for i, x in enumerate(parts)]))


def _span(shard: int, shards: int) -> tuple[int, int]:
    low = (shard << HASH_BITS) // shards
    return low, ((shard + 1) << HASH_BITS) // shards - low


# --- steps -----------------------------------------------------------------------------------------


def _send_grams(it: Iterator[pa.RecordBatch], plan: Plan, folder: str, shards: int, group_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema([("shard", pa.int32()), ("batch", pa.string()), ("grams", pa.binary())])
    part, number, hashes = TaskContext.get().partitionId(), 0, WordHash()
    group: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(doc_ids, raw) -> None:
        b = Batch(np.array(doc_ids, np.int64), raw, plan, hashes)
        b.save(f"{folder}/batches/{part:07}-{number:06}-{len(group):06}")
        g, several, _ = _distinct(anchors(b.symbols, b.ends, plan))
        group.append(((g << np.uint64(1)) | several.astype(np.uint64), _cuts(g, shards)))

    def send() -> pa.RecordBatch:
        nonlocal number
        name = _name(part, number, len(group))
        number += 1
        sizes = sum(np.diff(cut) for _, cut in group)
        home = zlib.crc32(name.encode()) % shards  # one shard hears of a group in any case
        use = [i for i in range(shards) if sizes[i] or i == home]
        rows = [_joined([v[cut[i] : cut[i + 1]] for v, cut in group], i, shards) for i in use]
        group.clear()
        return pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array([name] * len(use)), pa.array(rows, pa.binary())], schema=schema)

    doc_ids, raw, size, whole = [], [], 0, 0
    for b in it:
        for d, t in zip(ids(b.column(0)).tolist(), texts(b.column(1))):
            if raw and size + len(t) > plan.batch_bytes:
                flush(doc_ids, raw)
                whole += size
                doc_ids, raw, size = [], [], 0
                if whole + plan.batch_bytes > group_bytes or len(group) == 64:  # more might not fit into 64 bits in _joined
                    yield send()
                    whole = 0
            doc_ids.append(d), raw.append(t)
            size += len(t)
    if raw:
        flush(doc_ids, raw)
    if group:
        yield send()


def _find_repeated(pdf: pd.DataFrame, hot: int, shards: int) -> pd.DataFrame:
    """For each gram of each batch two bits: whether it occurs elsewhere too, and in more than hot batches."""
    own = [undelta(x) for x in pdf["grams"]]
    v = np.concatenate(own) % np.uint64(2 * _span(int(pdf["shard"].iloc[0]), shards)[1])  # a batch has a gram once
    _, inverse, count = np.unique(v >> np.uint64(1), return_inverse=True, return_counts=True)
    batches = count[inverse]
    bits = np.stack([(batches > 1) | (v & np.uint64(1)).astype(bool), batches > hot], 1)
    cut = np.cumsum([len(x) for x in own])[:-1]
    return pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"], "bits": [np.packbits(x).tobytes() for x in np.split(bits, cut)]})


def _contexts(b: Batch, a: dict[str, np.ndarray], again: np.ndarray, hot: np.ndarray, uri: str, shards: int, before: int) -> tuple:
    """The distinct contexts of a batch's repeated anchors, by shard: their shards, numbers (from before on), windows, whether they
    have a second place, places, sizes and text. What the anchors' numbers are goes to uri."""
    plan = b.plan
    a = {k: x[again] for k, x in a.items()}
    if (hot := hot[again]).any():
        a = split(a, hot, anchors(b.symbols, b.ends, replace(plan, gram=(plan.gram + plan.window) // 2)))
    lo, n = a["lo"], a["n"]
    doc = np.searchsorted(b.ends, lo, side="right")
    key, start = b.ids[doc] if len(lo) else lo, (lo - b.starts[doc] if len(lo) else lo) * plan.key_start
    order, new = suffixes(b, lo, n, key, start)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    pick = order[new]  # the smallest place of each distinct context
    later = (key > key[pick[number]]) | ((key == key[pick[number]]) & (start > start[pick[number]]))
    behind = order[later[order]]
    has, second = np.unique(number[behind], return_index=True)
    key2, start2 = np.full(len(pick), -1, np.int64), np.full(len(pick), -1, np.int64)  # the next larger place, if there is one
    key2[has], start2[has] = key[behind[second]], start[behind[second]]
    again2 = np.zeros(len(pick), bool)
    again2[has] = True
    write_file(uri, pack((number + before).astype("<u4"), lo.astype("<i8"), n.astype("u1"), later))
    shard = (a["gram"][pick] % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    q = pick[by]
    ctx = [b.text(x, x + k + plan.window - 1) for x, k in zip(lo[q].tolist(), n[q].tolist())]
    places = np.stack([key[q], start[q], key2[by], start2[by]], 1).astype("<i8")
    return shard[by], (by + before).astype("<u4"), n[q].astype("u1"), again2[by], places, np.array([len(x) for x in ctx], "<u4"), b"".join(ctx)


def _send_contexts(pdf: pd.DataFrame, plan: Plan, folder: str, shards: int) -> pd.DataFrame:
    name = pdf["batch"].iloc[0]
    # where each shard's answers begin: they are by batch, and in a batch by gram
    told = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in pdf["bits"]]
    at = np.zeros(shards, np.int64)
    at[pdf["shard"].to_numpy()] = np.cumsum([0] + [len(x) for x in told[:-1]])
    told = np.concatenate(told).astype(bool)
    parts, before = [], 0
    for file in _files(name):
        b = Batch.load(f"{folder}/batches/{file}", plan)
        a = anchors(b.symbols, b.ends, plan)
        g, _, which = _distinct(a)
        sizes = np.diff(_cuts(g, shards))
        first = _ranges(at, 2 * sizes)[::2]
        at += 2 * sizes
        parts.append(_contexts(b, a, told[first][which], told[first + 1][which], f"{folder}/contexts/{file}", shards, before))
        before += len(parts[-1][0])
        del a, b
    *cols, data = zip(*parts)
    edges = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.searchsorted(y, np.arange(shards + 1))].tolist() for x, y in zip(cols[5], cols[0])]
    shard, row, n, more, places, sizes = map(np.concatenate, cols)
    by = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[by], np.arange(shards + 1))
    row, n, more, places, sizes = row[by], n[by], more[by], places[by], sizes[by]
    out = []
    for i in np.flatnonzero(np.diff(cut)).tolist():
        x, y = int(cut[i]), int(cut[i + 1])
        ctx = b"".join([d[e[i] : e[i + 1]] for d, e in zip(data, edges)])
        out.append((i, name, pack(row[x:y], n[x:y], more[x:y], places[x:y].T, sizes[x:y], ctx)))
    out.append((zlib.crc32(name.encode()) % shards, name, b""))  # one shard hears of a group in any case
    return pd.DataFrame(out, columns=["shard", "batch", "contexts"])


def _judge(pdf: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """Runs of repeated windows, by batch: twice the record's number (and one, for its places behind the smallest), first window,
    window behind the last."""
    names = sorted(set(pdf["batch"]))
    at = {x: i for i, x in enumerate(names)}
    cols: list[list] = [[] for _ in range(5)]
    seen: dict[bytes, int] = {}
    number: list[int] = []
    for name, blob in zip(pdf["batch"], pdf["contexts"]):
        if not len(blob):
            continue
        row, n, more, places, sizes, data = unpack(blob, "<u4", "u1", "?", "<i8", "<u4", "bytes")
        places = places.reshape(4, -1)
        end = 0
        for k in sizes.tolist():
            number.append(seen.setdefault(data[end : end + k], len(seen)))
            end += k
        one = np.full(len(row), at[name]), 2 * row.astype(np.int64), n.astype(np.int64), places[0], places[1]
        for c, x in zip(cols, one):
            c.append(x)
        if more.any():  # as records of their own: what stands at places behind the smallest
            number += np.array(number[-len(row) :])[more].tolist()
            for c, x in zip(cols, (one[0][more], one[1][more] + 1, one[2][more], places[2][more], places[3][more])):
                c.append(x)
    out = []
    if number:
        batch, record, n, key, start = map(np.concatenate, cols)
        which = np.array(number)
        _, rank = np.unique(key, return_inverse=True)
        place = (rank.astype(np.int64) << 32) + start
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, which, place)
        size = np.zeros(len(seen), np.int64)
        size[which] = n
        by = np.argsort(least, kind="stable")
        ctx = list(seen)
        first_of = plan.engine([ctx[i] for i in by.tolist()], size[by], least[by], np.bincount(which, minlength=len(seen))[by], plan)
        del ctx, seen
        begin = np.empty(len(by), np.int64)
        begin[by] = np.cumsum(size[by]) - size[by]
        # all windows of all records: the smallest place of an equal window, against their own
        owner = np.repeat(np.arange(len(which)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        hit = first_of[begin[which[owner]] + within] < place[owner] + within * plan.key_start
        r, x, y = window_runs(within[hit], owner[hit])
        order = np.argsort(batch[r], kind="stable")
        r, x, y = r[order], x[order], y[order]
        for rows in np.split(np.arange(len(r)), np.flatnonzero(np.diff(batch[r])) + 1) if len(r) else []:
            out.append((names[int(batch[r[rows[0]]])], pack(record[r[rows]].astype("<i8"), x[rows].astype("u1"), y[rows].astype("u1"))))
    told = {x for x, _ in out}
    out += [(name, b"") for name, blob in zip(pdf["batch"], pdf["contexts"]) if not len(blob) and name not in told]
    return pd.DataFrame(out, columns=["batch", "runs"])


def window_runs(windows: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [first, behind) of window numbers, sorted by context, then number."""
    if not len(windows):
        return (np.empty(0, np.int64),) * 3
    new = np.ones(len(windows), bool)
    new[1:] = (contexts[1:] != contexts[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(windows)) - 1
    return contexts[at], windows[at], windows[last] + 1


def _cover(pdf: pd.DataFrame, plan: Plan, folder: str) -> pd.DataFrame:
    name = pdf["batch"].iloc[0]
    runs = [unpack(x, "<i8", "u1", "u1") for x in pdf["runs"] if len(x)]
    r, x, y = map(np.concatenate, zip(*runs)) if runs else (np.empty(0, np.int64),) * 3
    by = np.argsort(r, kind="stable")
    r, x, y = r[by], x[by], y[by]
    return pd.concat([_rows(f"{folder}/batches/{file}", f"{folder}/contexts/{file}", r, x, y, plan) for file in _files(name)])


def _rows(batch: str, contexts: str, r: np.ndarray, x: np.ndarray, y: np.ndarray, plan: Plan) -> pd.DataFrame:
    """What plan.finish makes of a batch's documents. Runs x to y of windows repeat in the records r, which are sorted; some may be of
    other batches."""
    b = Batch.load(batch, plan, False)
    number, lo, n, later = unpack(read_file(contexts), "<u4", "<i8", "u1", "?")
    step = np.zeros(int(b.ends[-1] if len(b.ends) else 0) + 1, np.int64)
    record = 2 * number.astype(np.int64) + later
    left, right = (np.searchsorted(r, record, side=s) for s in ("left", "right"))
    reps = right - left
    own, run = np.repeat(lo, reps), _ranges(left, reps)
    np.add.at(step, own + x[run], 1)
    np.add.at(step, own + y[run] - 1 + plan.window, -1)
    gone = np.cumsum(step[:-1]) > 0
    out = [plan.finish(b, i, gone[s:e]) for i, (s, e) in enumerate(zip(b.starts.tolist(), b.ends.tolist()))]
    frame = pd.DataFrame(out)
    frame.insert(0, "doc_id", pd.array([None if x == NULL_ID else x for x in b.ids.tolist()], dtype="Int64"))
    return frame


def removed(docs: DataFrame, plan: Plan, schema: str) -> DataFrame:
    """A row a document: doc_id and what plan.finish makes of it. Lazy, but for a sum over the lengths of texts."""
    spark = docs.sparkSession
    use_repo(spark)
    folder = shared_dir(spark)
    d = docs.select("doc_id", "text")
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    # small rows stand for much work, so these steps don't leave the number of tasks to the size of their rows
    parts = max(1, -(-total // (8 * plan.batch_bytes)), spark.sparkContext.defaultParallelism)
    group = _group_bytes(shards, plan.batch_bytes)
    grams_ = d.mapInArrow(lambda it: _send_grams(it, plan, folder, shards, group), "shard int, batch string, grams binary")
    repeated = grams_.groupBy("shard").applyInPandas(lambda p: _find_repeated(p, plan.hot, shards), "batch string, shard int, bits binary")
    contexts = repeated.repartition(parts, "batch").groupBy("batch").applyInPandas(lambda p: _send_contexts(p, plan, folder, shards), "shard int, batch string, contexts binary")
    runs = contexts.groupBy("shard").applyInPandas(lambda p: _judge(p, plan), "batch string, runs binary")
    return runs.repartition(parts, "batch").groupBy("batch").applyInPandas(lambda p: _cover(p, plan, folder), f"doc_id long, {schema}")

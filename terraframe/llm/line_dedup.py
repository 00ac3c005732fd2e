"""Line dedup: documents probe a sharded minimal perfect hash of all distinct lines.

1. Documents give the 128-bit hashes of their distinct long lines; Spark counts documents a hash (partial sums first, so that a hot
   line is one row a task).
2. All distinct hashes are split into shards of at most SHARD_KEYS keys. Each shard becomes one file in the shared folder: a minimal
   perfect hash (levels of bit arrays, about 3 bits a key, rank by popcount) with compact arrays by slot: a fingerprint of 16 bits and
   a count, which stops at the threshold (one byte up to 255). The largest doc_id is kept only for lines whose count reaches the
   threshold, by rank among them. The arrays decide what is dropped. A line of the documents indexed is always in the hash, so a
   fingerprint can only ever turn away lines of other documents (find() for a line that isn't indexed errs once in 65,536).
3. Documents are read again, PROBE_BYTES of text at a time, and their lines probe the files shard by shard, so that a file is read once
   for that much text; files stay in a cache of CACHE_BYTES. No line is joined or shuffled twice.

Nulls, ties, odd inputs: null text counts as one empty line. A document is a doc_id: several rows of one count once, and all rows with
the largest doc_id holding a line keep it. Null is a document that sorts before all others (only if every holder is null do they all
keep the line). An empty table gives an empty result. Other columns of docs pass through; of columns named as the results are, the
results' win.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batch, mix, read_file, shared_dir, slices, table, texts, use_repo, write_file

SHARD_KEYS = 100_000
CACHE_BYTES, PROBE_BYTES = 64 << 20, 16 << 20
SPACE = b" \t\n\x0b\x0c\r"
LOWEST = np.iinfo(np.int64).min
RESULTS = ("n_lines", "n_dropped")


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None if it is too short to count."""
    k = line.strip(SPACE)
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    return k.lower()  # of bytes: A-Z only


def _keys(it: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64())])
    for b in slices(it, 2000):
        digests, owner = bytearray(), []
        docs = b.column(0).cast(pa.int64()).fill_null(LOWEST).to_pylist()
        for d, text in zip(docs, b.column(1).to_pylist()):
            if text:
                found = {xxhash.xxh3_128_digest(k) for k in (key_of(x, min_chars) for x in text.encode().split(b"\n")) if k}
                digests += b"".join(found)
                owner += [d] * len(found)
        h = np.frombuffer(bytes(digests), ">i8").astype(np.int64).reshape(-1, 2)
        yield batch(schema, {"hi": h[:, 0], "lo": h[:, 1], "doc_id": owner})


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: at each level a key takes a bit no other key of the level wants."""

    GAMMA, LEVELS = 2, 40

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels, self.left = levels, left
        ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(b))]).astype(np.uint32) for b in levels]
        first = np.cumsum([0] + [int(o[-1]) for o in ones])
        self.rank, self.first = ones, first

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < cls.LEVELS:
            words = max(1, -(-cls.GAMMA * len(keys) // 64))
            at = cls._place(keys, len(levels), words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't in the set, some slot or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = self._place(keys[todo], i, 64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.first[i] + self.rank[i][word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
        if len(self.left) and len(todo):
            j = np.searchsorted(self.left, keys[todo]).clip(max=len(self.left) - 1)
            same = self.left[j] == keys[todo]
            out[todo[same]] = self.first[-1] + j[same]
        return out


def _pack(hi: np.ndarray, lo: np.ndarray, count: np.ndarray, last: np.ndarray, least: int) -> bytes:
    ph = PerfectHash.build(hi.view(np.uint64))
    at = ph.slots(hi.view(np.uint64))
    prints, counts, lasts = np.zeros(len(hi), np.uint16), np.zeros(len(hi), np.min_scalar_type(least)), np.zeros(len(hi), np.int64)
    prints[at], counts[at], lasts[at] = lo.view(np.uint64) >> np.uint64(48), count.clip(max=least), last
    np.savez(out := io.BytesIO(), left=ph.left, **{f"l{i:02}": x for i, x in enumerate(ph.levels)}, prints=prints, counts=counts, lasts=lasts[counts >= least])
    return out.getvalue()


def _build(pdf, folder: str, least: int):
    import pandas as pd

    # two lines with one first half but another second half: as good as impossible, but then they go to a list of their own
    pdf = pdf.sort_values(["hi", "lo"])
    twin = pdf["hi"].duplicated(keep=False).to_numpy()
    one, rest = pdf[~twin], pdf[twin]
    data = _pack(*(one[c].to_numpy(np.int64) for c in ("hi", "lo", "n", "last")), least)
    extra = rest[["hi", "lo", "n", "last"]].to_numpy(np.int64).tobytes()
    shard = int(pdf["shard"].iloc[0])
    write_file(f"{folder}/shards/{shard}.idx", len(data).to_bytes(8, "little") + data + extra)
    return pd.DataFrame({"shard": [shard], "n": [len(pdf)]})


class Shards:
    """The files of an index, each read when first probed; the least recently used go when CACHE_BYTES are full."""

    def __init__(self, folder: str, n: int, least: int):
        self.folder, self.n, self.least, self.kept, self.bytes, self.reads = folder, n, least, OrderedDict(), 0, 0

    def get(self, shard: int) -> tuple:
        if shard not in self.kept:
            raw = read_file(f"{self.folder}/shards/{shard}.idx")
            self.reads += 1
            cut = 8 + int.from_bytes(raw[:8], "little")
            z = np.load(io.BytesIO(raw[8:cut]))
            ph = PerfectHash([z[k] for k in sorted(z.files) if k[0] == "l" and k[1:].isdigit()], z["left"])
            extra = {(a, b): (n, c) for a, b, n, c in np.frombuffer(raw[cut:], np.int64).reshape(-1, 4).tolist()}
            self.kept[shard] = (ph, z["prints"], z["counts"], np.cumsum(z["counts"] >= self.least), z["lasts"], extra, len(raw))
            self.bytes += len(raw)
            while self.bytes > CACHE_BYTES and len(self.kept) > 1:
                self.bytes -= self.kept.popitem(last=False)[1][-1]
        self.kept.move_to_end(shard)
        return self.kept[shard]

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash: does its count reach the threshold, and the largest doc_id holding it if so."""
        hot, last = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        shard = shard_of(hi, self.n)
        order = np.argsort(shard, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(rows):
                ph, prints, counts, rank, lasts, extra, _ = self.get(int(shard[rows[0]]))
                at = ph.slots(hi[rows].view(np.uint64))
                ok = at >= 0
                ok[ok] = prints[at[ok]] == lo[rows][ok].view(np.uint64) >> np.uint64(48)
                ok[ok] = counts[at[ok]] >= self.least
                hot[rows], last[rows[ok]] = ok, lasts[rank[at[ok]] - 1]
                for r in rows if extra else ():
                    if (x := extra.get((int(hi[r]), int(lo[r])))) is not None:
                        hot[r], last[r] = x[0] >= self.least, x[1]
        return hot, last


def shard_of(hi: np.ndarray, n: int) -> np.ndarray:
    return (hi & np.int64(2**40 - 1)) % n


def buffered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to PROBE_BYTES."""
    own, size = [], 0
    for b in it:
        own.append(b)
        size += b.nbytes
        if size >= PROBE_BYTES:
            yield pa.concat_batches(own)
            own, size = [], 0
    if own:
        yield pa.concat_batches(own)


def _probe(it: Iterator[pa.RecordBatch], schema: pa.Schema, folder: str, n_shards: int, min_chars: int, least: int, sha: bool) -> Iterator[pa.RecordBatch]:
    shards = Shards(folder, n_shards, least)
    for b in buffered(slices(it)):
        docs = b.column("doc_id").cast(pa.int64()).fill_null(LOWEST).to_pylist()
        rows, lines, digests = [], [], bytearray()
        for i, text in enumerate(texts(b.column("text"))) if n_shards else ():
            for j, x in enumerate(text.split(b"\n")):
                if (k := key_of(x, min_chars)) is not None:
                    rows.append(i), lines.append(j)
                    digests += xxhash.xxh3_128_digest(k)
        h = np.frombuffer(bytes(digests), ">i8").astype(np.int64).reshape(-1, 2)
        dropped: dict[int, set[int]] = {}
        if len(h):
            hot, last = shards.find(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]))
            for r in np.flatnonzero(hot).tolist():
                if docs[rows[r]] != last[r]:
                    dropped.setdefault(rows[r], set()).add(lines[r])
        for k in range(0, b.num_rows, 500):
            part, own = b.slice(k, 500), [*texts(b.column("text").slice(k, 500))]
            cut = [dropped.get(k + i, ()) for i in range(len(own))]
            kept = [b"\n".join(x for j, x in enumerate(text.split(b"\n")) if j not in gone) if gone else text for text, gone in zip(own, cut)]
            new = {"n_lines": [x.count(b"\n") + 1 for x in own], "n_dropped": [*map(len, cut)]}
            if sha:
                new["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in kept]
            else:
                new["text"] = [x.decode() for x in kept]
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in schema], schema=schema)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, digest_only: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text, n_lines (before) and n_dropped. digest_only: doc_id, those two and
    kept_sha256 in place of the text. See the module for the method and for nulls and ties."""
    spark = docs.sparkSession
    use_repo(spark)
    folder = shared_dir(spark)
    source = docs.select("doc_id", "text")
    keys = source.mapInArrow(lambda it: _keys(it, min_chars), "hi long, lo long, doc_id long")
    counted = table(keys.groupBy("hi", "lo").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last")), "counted", folder)
    n_shards = -(-counted.count() // SHARD_KEYS)
    if n_shards:
        shard = (F.col("hi").bitwiseAND(F.lit(2**40 - 1)) % n_shards).cast("int")
        built = counted.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda pdf: _build(pdf, folder, min_docs), "shard int, n long")
        table(built, "built", folder)
    if digest_only:
        base = source
        fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    else:
        base = docs.select(*[c for c in docs.columns if c not in RESULTS])
        fields = [T.StructField(f.name, f.dataType) for f in base.schema]
    fields += [T.StructField(c, T.LongType()) for c in RESULTS] + [T.StructField("kept_sha256", T.StringType())] * digest_only
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    return base.mapInArrow(lambda it: _probe(it, arrow, folder, n_shards, min_chars, min_docs, digest_only), schema)

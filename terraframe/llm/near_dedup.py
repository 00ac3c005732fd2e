"""MinHash near-dedup by HyperMinHash.

Classes: documents with equal shingle sets (by a 128-bit digest of the sorted set) are one class, which its smallest doc_id stands for
from here on; where a doc_id stands in several rows, a number of the class does instead, and components are named by their smallest
doc_id at the end. So thousands of copies are one row, and no pairs within them arise.

Sketches: REGISTERS buckets; a shingle's hash gives a bucket and a value, and the bucket keeps the smallest value, stored as the
number of its leading zeros (6 bits) and the MANTISSA bits after them. Buckets that stay empty are filled in further rounds with
other hashes, until none is empty; for every bucket the first round in which either set has something is the one in which both
compare, so equal registers keep the Jaccard similarity as their probability, at any set size.

Candidates: BANDS bands of ROWS registers. Within a bucket of a band, each member is paired with the bucket's smallest id only, never
with all others. Pairs are first held against the sketches: the share of equal registers, corrected for the chance that compressed
values of sets of these two sizes collide, estimates the similarity; pairs more than MARGIN below the threshold are dropped (over six
standard errors). The rest are verified on the full sets. Then components are taken, and only buckets whose members lie in several
components go on: their sketches, in blocks of about BLOCK members, are compared where they lie, those outside of a bucket's largest
component with the others, and only pairs that the estimate lets through leave the task. A pair at similarity 0.8 shares no bucket with
a chance of about 2e-9.

Components: repeated star contraction over verified links, as tables, written to the shared folder each round.

Hot buckets: pairs are linear in a bucket's size; blocks of a mixed bucket of n members, m of them outside of its largest component,
are 2 n m / BLOCK rows, at most 2 n where m is below BLOCK. Joins by band key or leader are left to adaptive skew splitting. Texts are
joined only for documents in pairs left to verify.

Nulls and odd inputs: null or empty text and text without words has an empty set and is linked with nothing. With fewer words than a
shingle takes, the whole sequence is one shingle. A null doc_id is never linked and is its own class (component_id null, kept true).
Rows with one doc_id and equal text fall into one class and all carry kept by the same rule; with different texts, each row is judged
by its own text, and rows of one doc_id aren't linked for that. Empty tables work. Other columns pass
through in near_dedup; of columns named as the results are, the results' win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHash, mix, shared_dir, slices, table, use_repo

REGISTERS, BANDS, ROWS, MANTISSA = 256, 51, 5, 10
MARGIN, BLOCK, ROUNDS = 0.17, 1000, 100
THRESHOLD = (80, 100)


def shingles(text: str | None, size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the lower-cased words (ASCII white space parts words, A-Z is lowered)."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Compressed registers (uint16) of a set that isn't empty."""
    best = np.full(REGISTERS, 2**64 - 1, np.uint64)
    first = 0
    while True:
        rounds = max(1, min(4096, -(-4 * REGISTERS // len(s)))) if len(s) < 4 * REGISTERS else 1
        seeds = (np.arange(first, first + rounds, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h = mix(s[None, :] ^ mix(seeds)[:, None])
        # bucket: top 8 bits; order: round (16 bits), then the next 48 bits
        key = (np.arange(first, first + rounds, dtype=np.uint64)[:, None] << np.uint64(48)) | ((h << np.uint64(8)) >> np.uint64(16))
        np.minimum.at(best, (h >> np.uint64(56)).astype(np.int64).ravel(), key.ravel())
        first += rounds
        if first >= 65_000 or not (best == 2**64 - 1).any():
            break
    v = best & np.uint64(2**48 - 1)
    top = np.frexp(v.astype(np.float64))[1]  # bits in use; 48-bit integers are exact
    zeros = (48 - top).astype(np.uint64)
    shift = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    return ((zeros << np.uint64(MANTISSA)) | ((v >> shift) & np.uint64(2**MANTISSA - 1))).astype(np.uint16)


def bands(registers: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, one a row."""
    r = registers[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, i])
    return key.view(np.int64)


def _chance() -> np.ndarray:
    """[i, j]: the chance that the minima of 2**(i / 2) and of 2**(j / 2) other values have one compressed value: the sum over all
    compressed values of the chances of either minimum to lie there."""
    width = 2.0 ** -np.arange(1, 40)[:, None]
    edges = np.append((width * (1 + np.arange(2**MANTISSA) / 2**MANTISSA)).ravel(), 0.0)
    edges[::-1].sort()
    edges = np.append(1.0, edges)
    held = np.diff(-np.exp(np.sqrt(2.0) ** np.arange(49)[:, None] * np.log1p(-np.minimum(edges, 1 - 1e-15))), axis=1)  # P(min <= x) falls with x
    return np.abs(held) @ np.abs(held).T


CHANCE = _chance()


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that a register of two disjoint sets of n and m shingles is equal."""
    i, j = (np.clip(np.rint(2 * np.log2(np.maximum(np.asarray(x) / REGISTERS, 1))), 0, 48).astype(np.int64) for x in (n, m))
    return CHANCE[i, j]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches of sets of n and m shingles, row by row, corrected for chance collisions."""
    same, chance = (a == b).mean(axis=-1), collision(n, m)
    return np.maximum((same - chance) / (1 - chance), 0)


def _classify(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sketch", pa.binary())])
    hashes = WordHash()
    for b in slices(it):
        n, dig, sk = [], bytearray(), []
        for text in b.column(1).to_pylist():
            s = shingles(text, size, hashes)
            n.append(len(s))
            dig += xxhash.xxh3_128_digest(s.tobytes())
            sk.append(sketch(s).tobytes() if len(s) else None)
        h = np.frombuffer(bytes(dig), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(sk, pa.binary())], schema=schema)


def _banded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(it, 2000):
        keys = [bands(np.frombuffer(x, np.uint16)) for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "id"])


def _likely(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sketch of a, sketch of b, sizes) whose estimate is at least least, with it."""
    for t in slices(it, 4000):
        x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
        e = estimate(x, y, t.column(4).to_numpy(), t.column(5).to_numpy())
        keep = pa.array(e >= least)
        yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep), pa.array(e).filter(keep)], names=["a", "b", "estimate"])


def _across(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Likely pairs of different components in blocks (rows sorted by key, q, r, minor): the minor ones' sketches with the others'."""

    def block(t: pa.Table) -> list[np.ndarray]:
        minor = t["minor"].to_numpy().astype(bool)
        ids, c, n = (t[x].to_numpy() for x in ("id", "c", "n"))
        sketches = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        others, out = np.flatnonzero(~minor), []
        for i in np.flatnonzero(minor).tolist():
            j = others[c[others] != c[i]]
            e = estimate(sketches[i], sketches[j], n[i], n[j])
            keep = j[e >= least]
            out.append(np.stack([np.maximum(ids[keep], ids[i]), np.minimum(ids[keep], ids[i])]))
        return out

    def pairs(t: pa.Table) -> pa.RecordBatch:
        k = np.stack([t[x].to_numpy() for x in ("key", "q", "r")])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        found = [x for a, b in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows]) for x in block(t.slice(a, b - a))]
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rest: pa.Table | None = None
    for t in slices(it, 4000):
        t = pa.Table.from_batches([t])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = [t[x][-1] for x in ("key", "q", "r")]
        k = np.stack([t[x].to_numpy() == v.as_py() for x, v in zip(("key", "q", "r"), last)]).all(axis=0)
        begin = t.num_rows - int(np.argmin(k[::-1])) if not k.all() else 0  # the last block may go on
        rest = t.slice(begin)
        if begin:
            yield pairs(t.slice(0, begin))
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def _verify(it: Iterator[pa.RecordBatch], size: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    hashes, last, own = WordHash(), None, None
    for t in slices(it):
        keep = []
        for b, ta, tb in zip(t.column(1).to_pylist(), t.column(2).to_pylist(), t.column(3).to_pylist()):
            if b != last:
                last, own = b, shingles(tb, size, hashes)
            s = shingles(ta, size, hashes)
            common = len(np.intersect1d(s, own, assume_unique=True))
            keep.append(common > 0 and den * common >= num * (len(s) + len(own) - common))
        yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(keep, pa.bool_())), t.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])


def _print(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, of every id in links. Each round gives every node's neighbours the
    smallest of them (small star), then larger neighbours the smallest one (large star), until nothing changes."""
    edges = table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}0", folder)
    known = _print(edges)
    for k in range(1, ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = table(large.filter("a <> b").distinct(), f"{name}{k}l", folder)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = large.join(least, large["a"] == least["n"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        new = table(small.filter("a <> b").distinct(), f"{name}{k}s", folder)
        print_ = _print(new)
        if print_ == known:
            break
        edges, known = new, print_
    else:
        raise RuntimeError(f"components haven't settled after {ROUNDS} rounds")
    return new.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")


def _linked(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the digest (hi, lo) of the shingles, of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    use_repo(spark)
    folder = shared_dir(spark)
    num, den = threshold
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    rows = table(source.mapInArrow(lambda it: _classify(it, size), "doc_id long, n_shingles long, hi long, lo long, sketch binary"), "sketches", folder)
    live = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    # does a doc_id stand in several rows? then it doesn't tell classes apart
    repeated = rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "classes", folder) if repeated else classes.withColumn("id", F.col("rep"))
    rep = live.join(classes, ["hi", "lo"]).filter("doc_id = rep").dropDuplicates(["id"])
    sketches = table(rep.select("id", "sketch", F.col("n_shingles").alias("n")), "reps", folder)

    banded = sketches.select("id", "sketch").mapInArrow(_banded, "key long, id long")
    # members of buckets that hold several, each with the bucket's smallest id
    leaders = banded.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = table(banded.join(leaders, "key"), "members", folder)

    least = num / den - MARGIN

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        near = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "na", "nb")
        return table(near.mapInArrow(lambda it: _likely(it, least), "a long, b long, estimate double"), "likely1", folder)

    def across(members: DataFrame) -> DataFrame:
        """Likely pairs of members (key, id, c) of one bucket whose components c differ."""
        sizes = members.groupBy("key", "c").count().groupBy("key").agg(F.sum("count").alias("all"), F.max("count").alias("most"), F.max_by("c", F.struct("count", "c")).alias("major"))
        sizes = sizes.select("key", "major", F.ceil(F.col("all") / BLOCK).cast("int").alias("rs"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("qs"))
        m = members.join(sizes, "key").join(sketches, "id")
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["id", "c", "n", "sketch"]
        one = m.select("key", every("qs").alias("q"), part("rs").alias("r"), F.lit(0).alias("minor"), *columns)
        two = m.filter("c <> major").select("key", part("qs").alias("q"), every("rs").alias("r"), F.lit(1).alias("minor"), *columns)
        blocks = one.unionByName(two).repartition("key", "q", "r").sortWithinPartitions("key", "q", "r", "minor")
        return table(blocks.mapInArrow(lambda it: _across(it, least), "a long, b long").distinct(), "likely2", folder)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        if repeated:  # a class's text is any with its digest
            asked = table(asked.join(classes, "id").select("id", F.col("rep").alias("doc_id"), "hi", "lo"), f"{name}-asked", folder)
            held = _digested(source.join(asked.select("doc_id").distinct(), "doc_id"), size).join(asked, ["doc_id", "hi", "lo"]).dropDuplicates(["id"])
        else:
            asked = table(asked.withColumnRenamed("id", "doc_id"), f"{name}-asked", folder)
            held = source.join(asked, "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
        held = table(held.select("id", "text"), f"{name}-texts", folder)
        a, b = (held.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        return table(both.mapInArrow(lambda it: _verify(it, size, num, den), "a long, b long"), name, folder)

    pairs = likely(members.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
    # one link a member is enough to begin with: the likeliest; others only where components still differ
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    links = verified(best, "links1")
    part = table(_components(links, folder, "cc1-"), "part1", folder)
    named = members.join(part, "id", "left").select("key", "id", "lead", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("key")
    left = table(named.join(mixed, "key").select("key", "id", "c"), "mixed", folder)
    links = links.unionByName(verified(across(left).join(best, ["a", "b"], "left_anti"), "links2"))
    part = table(_components(links, folder, "cc2-"), "part2", folder)
    if repeated:  # components are named by numbers of classes; each takes the smallest doc_id of its classes
        of = part.select("id", "component").union(part.select("component", "component").distinct())
        of = of.join(classes.select("id", "rep"), "id")
        least = of.groupBy("component").agg(F.min("rep").alias("least"))
        part = of.join(least, "component").select("id", F.col("least").alias("component"))
    found = live.join(classes, ["hi", "lo"]).join(part, "id", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "hi", "lo")
    rest = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "hi", "lo")
    every = found.unionByName(rest)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _digested(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text and the digest (hi, lo) of the text's shingles."""

    def run(it):
        hashes = WordHash()
        for b in slices(it):
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(shingles(t, size, hashes).tobytes()) for t in b.column(1).to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "text", "hi", "lo"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, hi long, lo long")


def link_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, of every row of docs (doc_id, text)."""
    return _linked(docs, size, threshold).select("doc_id", "n_shingles", "component_id", "kept")


def near_dedup(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs without the documents that a smaller doc_id's component covers; all columns of docs stay as they are. Of rows with the
    kept doc_id, all stay."""
    found = table(_linked(docs, size, threshold).filter("doc_id is not null").groupBy("doc_id", "hi", "lo").agg(F.min("kept").alias("kept")), "found")
    fates = table(found.groupBy("doc_id").agg(F.min("kept").alias("all"), F.max("kept").alias("any")).filter("not all").select(F.col("doc_id").alias("__gone"), "any"), "gone")
    gone = fates.filter("not any").drop("any")
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    mixed = fates.filter("any").drop("any")
    if not mixed.limit(1).count():
        return left
    # of some rows of these only the text goes
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(mixed, F.col("doc_id") == F.col("__gone"), "left_semi").distinct()
    texts = _digested(own, size).join(found.filter("not kept"), ["doc_id", "hi", "lo"]).select(F.col("doc_id").alias("__gone"), F.col("text").alias("__text"))
    texts = table(texts, "gone-texts")
    return left.join(texts, (left["doc_id"] == texts["__gone"]) & (left["text"] == texts["__text"]), "left_anti")

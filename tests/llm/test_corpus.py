"""Every corpus operator against brute force or SQL, on a fixture with nulls, ties, repeated rows and odd texts, and on a small table."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import types as T

from terraframe.llm import oracle, queries

SF = f"{DATA}/sf0.001"
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("kept", T.StringType()), ("n_words", T.StringType()), ("spans", T.StringType()), ("score", T.StringType()))])
WORDS = "alpha beta gamma delta Epsilon zeta eta theta iota kappa lambda mu nu xi omicron the of and to in".split()


def texts():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    line, passage, base = prose(9) + " shared line of more than forty characters", prose(60), prose(120)
    out = [None, "", " ", "\n", "\n\n a \n", "word", "two words", "The " * 300, "a b " * 200, "héé 漢字 " * 30, "x" * 5000, "\t" + passage, prose(40) + " " + passage + " " + prose(30), passage, base, base, base + " more", base.upper(), base.replace(" ", "\n"), prose(9000)]
    out += [f"{prose(12)}\n{line}\n{prose(8)}\n  {line.upper()} " for _ in range(6)]
    out += ['password = "hunter22x" and AKIA' + "Q7" * 9 + " then " + "0123456789abcdef" * 2 + " token=token:longvalue1 api_key:abc ghp_" + "a1" * 20, "é" * 3 + "secret:" + "z" * 9 + "\n" + "AKIA1 akia PASSWD:'aaaaaaa'"]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    return [(i * 3 % 101, x, [None, "en", "xx"][i % 3], None, None if x is None else len(x), "k", "n", "s", "z") for i, x in enumerate(t)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """With a null doc_id and repeated rows, the same and other texts under one id."""
    more = [(None, *rows[14][1:]), rows[14], rows[14], (rows[14][0], *rows[12][1:]), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows + more, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace as Of

    from terraframe.llm.common import shared_dir

    session = lambda master, folder: Of(conf=Of(get=lambda *_: folder, set=lambda *_: None), sparkContext=Of(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session("spark://host:7077", None))
    assert shared_dir(session("spark://host:7077", "/shared/")).startswith("file:///shared/tf-")
    assert shared_dir(session("yarn", "hdfs://x/y")).startswith("hdfs://x/y/tf-")
    assert shared_dir(session("local[2]", None)).startswith("file:///")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    import os

    got = queries.queries()[name](spark, SF)
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    want = c.execute(oracle.SQL[name])
    names = [x[0] for x in want.description]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(names).collect()), key=key) == sorted(want.fetchall(), key=key)


def fates(frame, *columns):
    """All rows, counted: (doc_id, columns), for tables in which a doc_id stands in several rows or none."""
    return collections.Counter(tuple(r[c] for c in ("doc_id", *columns)) for r in frame.collect())


ODD = lambda rows: rows + [(None, *rows[14][1:]), rows[14], rows[14], (rows[14][0], *rows[12][1:]), (None, *[None] * 8)]


def brute_bytes(rows):
    """Rows of one doc_id don't remove from each other; a null one is the largest."""
    key = lambda d: 2**63 - 1 if d is None else d
    first, out = {}, []
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            x = b[i : i + 50]
            first[x] = min(first.get(x, key(d)), key(d))
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return collections.Counter(out)


BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup(docs, rows, odd, none):
    from terraframe.llm.suffix_dedup import dedup_bytes

    found = dedup_bytes(docs)
    assert fates(found, *BYTES) == brute_bytes(rows)
    r = by_id(found)[rows[12][0]]
    edges = np.frombuffer(r.spans, "<i8").reshape(-1, 2)
    assert len(r.kept) + int((edges[:, 1] - edges[:, 0]).sum()) == r.n_bytes
    assert fates(dedup_bytes(odd, True), *BYTES) == brute_bytes(ODD(rows)) and dedup_bytes(none).count() == 0


@pytest.mark.parametrize("hot", [0, 10**9])
def test_suffix_dedup_small_batches(spark, odd, rows, hot):
    """Batches smaller than some texts, hot grams cut by longer ones; and with an engine that finds nothing, nothing goes."""
    from terraframe.llm import suffix_dedup as S
    from terraframe.llm.repeats import Plan, removed

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    plan = lambda engine: Plan(False, 50, 20, False, 3000, engine, S._digest, hot)
    assert fates(removed(odd, plan(S.engine), schema), *BYTES) == brute_bytes(ODD(rows))
    nothing = lambda contexts, n, place, weight, plan: np.full(n.sum(), np.iinfo(np.int64).max)
    assert removed(odd, plan(nothing), schema).filter("n_removed > 0").count() == 0


def travelled(monkeypatch, folder, frame, shard_bytes):
    """The rows of frame(), and how many batches and groups of them there were, with small shards."""
    from terraframe.llm import repeats as R

    monkeypatch.setattr(R, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(R, "shared_dir", lambda spark: f"file://{folder}")
    found = frame().collect()
    names = [p.name for p in (folder / "batches").iterdir()]
    return found, len(names), len({x[:14] for x in names})  # part and number


def test_suffix_dedup_groups(monkeypatch, tmp_path, odd, rows):
    """Where shards are many, batches travel in groups, not in a row for each batch and shard."""
    from terraframe.llm import suffix_dedup as S
    from terraframe.llm.repeats import Plan, removed

    plan = Plan(False, 50, 20, False, 3000, S.engine, S._digest)
    frame = lambda: removed(odd.coalesce(1), plan, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    found, batches, groups = travelled(monkeypatch, tmp_path, frame, 20_000)
    assert collections.Counter(tuple(r[c] for c in ("doc_id", *BYTES)) for r in found) == brute_bytes(ODD(rows))
    assert batches >= 8 and groups <= batches // 4


def test_suffix_levels():
    from terraframe.llm.suffix_dedup import Family

    r, family, seen = random.Random(1), Family(3), {}
    for doc in range(60):
        text = bytes(r.choice(b"ab\0c") for _ in range(r.randrange(3, 60)))
        at = np.array([i for i in range(len(text) - 2) if r.random() < 0.8] or [0])
        own = [text[i : i + 3] for i in at]
        assert family.add(np.frombuffer(text, np.uint8), at, np.full(len(at), doc)).tolist() == [min(seen.get(x, doc), doc) for x in own]
        for x in own:
            seen.setdefault(x, doc)
        sizes = [len(x.sa) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        for level in family.levels:
            suffixes = [level.text.tobytes()[i : i + 3] for i in level.sa]
            assert suffixes == sorted(set(suffixes)) and [seen[x] for x in suffixes] <= level.least.tolist()


def brute_words(rows):
    """As brute_bytes, but an equal window earlier in the same document counts too."""
    key = lambda d: 2**63 - 1 if d is None else d
    first, out = {}, []
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            first[x] = min(first.get(x, (key(d), i)), (key(d), i))
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (key(d), i):
                gone[i : i + 20] = [True] * 20
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return collections.Counter(out)


TOKENS = ("n_words", "n_removed", "kept_sha256")


def test_fm_dedup(docs, rows, odd, none):
    from terraframe.llm.fm_dedup import dedup_words

    assert fates(dedup_words(docs), *TOKENS) == brute_words(rows)
    assert fates(dedup_words(odd), *TOKENS) == brute_words(ODD(rows)) and dedup_words(none).count() == 0


@pytest.mark.parametrize("hot", [0, 10**9])
def test_fm_dedup_small_batches(odd, rows, hot):
    from terraframe.llm import fm_dedup as M
    from terraframe.llm.repeats import Plan, removed

    schema = "n_words long, n_removed long, kept_sha256 string"
    plan = lambda engine: Plan(True, 20, 8, True, 3000, engine, M._digest, hot)
    assert fates(removed(odd, plan(M.engine), schema), *TOKENS) == brute_words(ODD(rows))
    nothing = lambda contexts, n, place, weight, plan: np.full(n.sum(), np.iinfo(np.int64).max)
    assert removed(odd, plan(nothing), schema).filter("n_removed > 0").count() == 0


def test_fm_dedup_groups(monkeypatch, tmp_path, odd, rows):
    from terraframe.llm import fm_dedup as M
    from terraframe.llm.repeats import Plan, removed

    plan = Plan(True, 20, 8, True, 3000, M.engine, M._digest)
    frame = lambda: removed(odd.coalesce(1), plan, "n_words long, n_removed long, kept_sha256 string")
    found, batches, groups = travelled(monkeypatch, tmp_path, frame, 20_000)
    assert collections.Counter(tuple(r[c] for c in ("doc_id", *TOKENS)) for r in found) == brute_words(ODD(rows))
    assert batches >= 8 and groups <= batches // 4


def test_wavelet_ranks():
    """Against counting; a search reads each level once for both ends of an interval."""
    from terraframe.llm import fm_dedup as M

    r = np.random.default_rng(4)
    seq = r.integers(0, 37, 900)
    wavelet = M.Wavelet(seq, 37)
    c, lo = r.integers(0, 37, 200), r.integers(0, 901, 200)
    hi = np.minimum(lo + r.integers(0, 300, 200), 900)
    calls = []
    for bits in wavelet.levels:
        bits.rank1 = lambda i, f=bits.rank1: calls.append(len(i)) or f(i)
    a, b = wavelet.ranks(c, lo, hi)
    assert a.tolist() == [int((seq[:x] == k).sum()) for k, x in zip(c, lo)] and b.tolist() == [int((seq[:x] == k).sum()) for k, x in zip(c, hi)]
    assert sum(calls) == 400 * wavelet.depth


def test_fm_index():
    from terraframe.llm.fm_dedup import FMIndex

    r = np.random.default_rng(3)
    text = np.append(r.integers(1, 6, 700), 0)
    weight = np.full(len(text), 1)
    index = FMIndex(text, weight)
    for k in (1, 3, 6, 8):
        for i in range(0, 600, 37):
            p = text[i : i + k]
            lo, hi = np.array([0]), np.array([index.n])
            for c in p[::-1]:
                lo, hi = index.step(np.array([c]), lo, hi)
            want = sorted(j for j in range(len(text) - k + 1) if (text[j : j + k] == p).all())
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want
    ends = np.arange(8, 700, 11)
    length, lo, hi = index.matching(text, ends, 6)
    for e, n, a, b in zip(ends.tolist(), length.tolist(), lo.tolist(), hi.tolist()):
        held = lambda k, e=e: [j for j in range(len(text) - k + 1) if (text[j : j + k] == text[e - k : e]).all()]
        assert n == max([k for k in range(1, 7) if weight[held(k)].sum() > 1], default=0)
        assert (b - a) == (len(held(6)) if n == 6 else 0)


def brute_near(rows, n):
    sets, reach = {}, {}
    for d, t in ((r[0], r[1] or "") for r in rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in w]
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        reach[d] = d
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and (c := len(sets[a] & sets[b])) and 100 * c >= 80 * len(sets[a] | sets[b])]
    last = None
    while last != reach:
        last = dict(reach)
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    return {d: (len(sets[d]), reach[d], reach[d] == d) for d in ids}


def brute_near_rows(rows, n):
    """For tables with repeated ids: each row by its own text; rows with a null id stand alone."""
    w = [[re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")] for r in rows]
    sets = [{tuple(x[i : i + n]) for i in range(max(1, len(x) - n + 1))} if x else set() for x in w]
    ids = [r[0] for r in rows]
    reach = [*ids]
    live = [i for i, d in enumerate(ids) if d is not None and sets[i]]
    links = [(i, j) for i in live for j in live if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            reach[i] = reach[j] = min(reach[i], reach[j])
    return collections.Counter((d, len(s), c, d is None or d == c) for d, s, c in zip(ids, sets, reach))


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(spark, docs, rows, size):
    from terraframe.llm.near_dedup import link_components

    r = random.Random(9)
    base = [r.choice(WORDS) + str(r.randrange(99)) for _ in range(150)]
    chain = []
    for i in range(25):  # each links with the next, the ends don't link
        base = base[4:] + [f"new{i}{k}" for k in range(4)]
        chain.append((500 + i * 7 % 29, " ".join(base), *rows[0][2:]))
    every = rows + chain
    got = by_id(link_components(spark.createDataFrame(every, DOCS), size))
    assert {d: (x.n_shingles, x.component_id, x.kept) for d, x in got.items()} == brute_near(every, size)


def test_near_dedup_odd(odd, rows, none):
    from terraframe.llm.near_dedup import link_components, near_dedup

    want = brute_near_rows(ODD(rows), 5)
    assert fates(link_components(odd), "n_shingles", "component_id", "kept") == want and link_components(none).count() == 0
    assert near_dedup(odd).columns == odd.columns and near_dedup(none).count() == 0


def test_near_dedup_texts_under_one_id(spark):
    from terraframe.llm.near_dedup import link_components, near_dedup

    r = random.Random(4)
    text = lambda: [r.choice(WORDS) + str(r.randrange(99)) for _ in range(120)]
    rows = []
    for k in range(8):  # eight texts under one id, each with a near copy of its own, and an older copy of the first
        own = text()
        rows += [(5, " ".join(own)), (100 + k, " ".join([*own[:-2], "x", "y"]))]
    rows += [(2, rows[0][1] + " z"), (5, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((x.doc_id, x.component_id, x.kept) for x in link_components(d).collect())
    assert got == {(5, 5, True): 7, (5, 2, False): 2, (2, 2, True): 1, (100, 2, False): 1} | {(100 + k, 5, False): 1 for k in range(1, 8)}
    assert sorted((x.doc_id, x.text) for x in near_dedup(d).collect()) == sorted([rows[-2], *rows[2:16:2]])


def test_sketch_estimates():
    from terraframe.llm.near_dedup import estimate, sketch

    r = np.random.default_rng(2)
    for n in (1, 3, 20, 300, 5000):
        for share in (0.0, 0.5, 0.8, 1.0):
            x = np.unique(r.integers(0, 2**63, 2 * n, dtype=np.uint64))
            k = round(share * n)
            a, b = np.sort(np.concatenate([x[:k], x[k : n]])), np.sort(np.concatenate([x[:k], x[n : 2 * n - k]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs(float(estimate(sketch(a)[None], sketch(b)[None], len(a), len(b))[0]) - true) < 0.17


def test_chance_collisions_depend_on_sizes():
    from terraframe.llm.near_dedup import REGISTERS, collision, sketch

    r = np.random.default_rng(5)
    own = lambda n: sketch(r.integers(0, 2**63, n, dtype=np.uint64))
    for n, m in ((2000, 2000), (2000, 60_000), (300, 300)):
        seen = np.mean([(own(n) == own(m)).mean() for _ in range(120)])
        want = float(collision(n, m))
        assert abs(seen - want) < 4 * (want / (120 * REGISTERS)) ** 0.5 + 1e-4, (n, m, seen, want)
    assert collision(2000, 60_000) < collision(2000, 2000) / 3


def test_near_dedup_template_family(spark, monkeypatch):
    """Texts of one template share buckets, but few are links; and a block never holds a whole bucket here."""
    from terraframe.llm import near_dedup as N

    monkeypatch.setattr(N, "BLOCK", 5)
    r = random.Random(12)
    template = [f"t{i}" for i in range(80)]
    rows = []
    for k in range(60):
        rows.append((1000 - k, " ".join(template + [f"own{k // 2 if k < 20 else k}w{i}" for i in range(36)] + [f"last{k}"])))
    r.shuffle(rows)
    got = by_id(N.link_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: (x.n_shingles, x.component_id, x.kept) for d, x in got.items()} == brute_near(rows, 5)
    assert sum(not x.kept for x in got.values()) == 10


def test_components_that_do_not_settle_are_an_error(spark, tmp_path, monkeypatch):
    from terraframe.llm import near_dedup as N

    links = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    assert {(x.id, x.component) for x in N._components(links, f"file://{tmp_path}/a", "c").collect()} == {(i, 0) for i in range(1, 41)}
    monkeypatch.setattr(N, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="settled"):
        N._components(links, f"file://{tmp_path}/b", "c")


def test_warc(spark):
    from terraframe.llm.warc import read_archives, write_archives

    big = "<p>é</p>" * 200
    rows = [(1, "u", big), (2, None, big), (9, "u\r\nX: y", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (None, "u", big), (9, "v", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = write_archives(pages.repartition(2))
    got = read_archives(manifest).collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 9), (1, "revisit", 9), (2, "revisit", 9), (3, "response", None), (4, "response", None), (5, "response", None), (9, "response", None), (9, "response", None)]
    for r in got:
        want = {3: b"small", 4: b"small", 5: b""}.get(r.page_id, big.encode())
        assert r.payload_bytes == len(want) and r.payload_digest == hashlib.sha1(want).hexdigest()
        assert r.record_type == "revisit" or r.payload == want
    assert read_archives(write_archives(pages.filter("false"))).count() == 0


def test_warc_several_members(spark, tmp_path):
    import gzip
    import json

    from terraframe.llm.warc import ZipWriter, read_archives, record

    def package(name, indexes):
        with open(tmp_path / name, "wb") as f:
            z = ZipWriter(f)
            for m in range(2):
                z.member(f"archive/part{m}.warc.gz", iter([raw(m, p) for p in range(3)]))
            for index, lines in indexes.items():
                z.member(f"indexes/{index}", (json.dumps(x).encode() + b"\n" for x in lines))
            z.close()
        return [r.page_id for r in read_archives(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string")).orderBy("page_id").collect()]

    raw = lambda m, p: gzip.compress(record("response", 10 * m + p, "u", b"x%d" % p, hashlib.sha1(b"x%d" % p).hexdigest(), None), mtime=0)
    at = lambda m: [{"offset": sum(len(raw(m, q)) for q in range(p)), "length": len(raw(m, p)), "page_id": 10 * m + p} for p in range(3)]
    want = [0, 1, 2, 10, 11, 12]
    assert package("a.zip", {"part0.jsonl": at(0), "part1.jsonl": at(1)}) == want
    assert package("b.zip", {"all.jsonl": [x | {"member": f"part{m}.warc.gz"} for m in (1, 0) for x in at(m)]}) == want
    with pytest.raises(Exception, match="no index covers"):
        package("c.zip", {"part0.jsonl": at(0)})


@pytest.mark.parametrize("zip64", [False, True])
def test_zip(zip64):
    import io
    import zipfile

    from terraframe.llm.warc import ZipReader, ZipWriter

    f = io.BytesIO()
    z = ZipWriter(f, zip64)
    z.member("a/b.warc", iter([b"hello ", b"world"]))
    z.member("é.txt", iter([b""]))
    z.close()
    assert zipfile.ZipFile(f).testzip() is None and zipfile.ZipFile(f).read("a/b.warc") == b"hello world"
    assert ZipReader(f, len(f.getvalue())).read("a/b.warc", 6, 5) == b"world"
    g = io.BytesIO()
    with zipfile.ZipFile(g, "w") as other:
        other.comment = b"PK\x05\x06 in a comment"
        other.writestr("x", b"123")
        other.writestr("y", b"1" * 99, zipfile.ZIP_DEFLATED)
    r = ZipReader(g, len(g.getvalue()))
    assert r.read("x", 1, 1) == b"2"
    for bad in (lambda: r.read("y"), lambda: r.read("x", 2, 5), lambda: ZipReader(io.BytesIO(b"no"), 2)):
        with pytest.raises(ValueError):
            bad()


def strip_line(x):
    return x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows):
    """(doc_id, text, lines, dropped lines) of each row; a null doc_id is a document that sorts before all others."""
    held = collections.defaultdict(set)
    key = lambda d: -(2**63) if d is None else d
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[strip_line(x)].add(key(d))
    hot = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    out = []
    for d, t, *_ in rows:
        x = (t or "").split("\n")
        stay = [y for y in x if hot.get(strip_line(y), key(d)) == key(d)]
        out.append((d, "\n".join(stay), len(x), len(x) - len(stay)))
    return collections.Counter(out)


def test_line_dedup(spark, docs, rows, odd, none, monkeypatch):
    from terraframe.llm import line_dedup as L

    names = ("text", "n_lines", "n_dropped")
    want = brute_lines(rows)
    assert any(n for *_, n in want) and fates(L.dedup_lines(docs), *names) == want
    assert fates(L.dedup_lines(odd), *names) == brute_lines(ODD(rows)) and L.dedup_lines(none).count() == 0
    # rows of one document count once
    line = "a line of more than forty characters that three documents hold"
    few = [(1, line)] * 3 + [(2, line), (3, f"x\n{line.upper()}  ")]
    many = few + [(k, line) for k in (4, 9, 9)] + [(None, line)]
    for own in (few, many):
        assert fates(L.dedup_lines(spark.createDataFrame(own, "doc_id long, text string")), *names) == brute_lines(own)
    monkeypatch.setattr(L, "SHARD_KEYS", 20)
    monkeypatch.setattr(L, "CACHE_BYTES", 1)
    assert fates(L.dedup_lines(docs), *names) == want
    k = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    assert sorted(L.PerfectHash.build(k).slots(k).tolist()) == [*range(5000)]


def test_line_index_larger_than_its_cache(tmp_path, monkeypatch):
    import pandas as pd
    import pyarrow as pa

    from terraframe.llm import line_dedup as L

    r = np.random.default_rng(7)
    hi, lo, n, last = (r.integers(-(2**62), 2**62, 4000) for _ in range(4))
    n = np.abs(n) % 9 + 1
    every = pd.DataFrame({"hi": hi, "lo": lo, "n": n, "last": last, "shard": L.shard_of(hi, 20)})
    for _, own in every.groupby("shard"):
        L._build(own, f"file://{tmp_path}", 5)
    monkeypatch.setattr(L, "CACHE_BYTES", 1)
    shards = L.Shards(f"file://{tmp_path}", 20, 5)
    hot, found = shards.find(hi, lo)
    assert (hot == (n >= 5)).all() and (found[hot] == last[hot]).all() and shards.reads == 20  # each file once a buffer
    assert shards.find(hi, lo + (1 << 50))[0].sum() == 0
    b = pa.record_batch({"x": ["y" * 1000] * 10})
    monkeypatch.setattr(L, "PROBE_BYTES", 3 * b.nbytes)
    assert [x.num_rows for x in L.buffered(iter([b] * 7))] == [30, 30, 10]


def brute_benchmark(rows, items):
    norm = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for d, x, *_ in rows:
        w, hit, found = norm(x), set(), set()
        for i, y in items:
            v = norm(y)
            n = min(8, len(v))
            for k in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        found |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return collections.Counter(out)


def benchmark_fates(frame):
    return collections.Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in frame.collect())


def test_decontaminate(spark, docs, rows, odd, none):
    from terraframe.llm import decontaminate as D

    t = texts()
    items = [(1, " ".join(t[14].split()[5:30])), (2, "  TWO, words! "), (3, None), (4, "..."), (10, t[13]), (10, "word"), (None, "alpha")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_benchmark(docs, bench)
    assert benchmark_fates(found) == brute_benchmark(rows, items)
    r = by_id(found)[rows[14][0]]
    norm = lambda x: re.findall(r"[a-z0-9]+", x.lower())
    assert norm(t[14][r.spans[0].start : r.spans[0].end]) == norm(items[0][1])
    assert benchmark_fates(D.find_benchmark(odd, bench)) == brute_benchmark(ODD(rows), items) and D.find_benchmark(none, bench).count() == 0
    assert D.find_benchmark(docs, bench.filter("false")).filter("n_hit > 0").count() == 0
    with pytest.raises(ValueError, match="max_windows"):
        D.find_benchmark(docs, bench, max_windows=20)


def test_many_words_are_spelt_apart():
    from terraframe.llm.decontaminate import Patterns

    r = random.Random(6)
    words = [f"w{i}é" for i in range(5000)]  # three letters a word
    item = [r.choice(words) for _ in range(5000)]
    p = Patterns.of([(" ".join(item[i : i + 8]), str(i // 50)) for i in range(len(item) - 7)] + [(" ".join(words[i : i + 8]), None) for i in range(0, 4992, 8)])
    assert p.width == 3
    for _ in range(50):
        i = r.randrange(4900)
        n, runs, found, longest = p.hits(" ".join(["x", words[3], *item[i : i + 11], "y z", *item[i + 20 : i + 27]]))
        assert (n, runs, found, longest) == (22, [(2, 13)], {str(k // 50) for k in range(i, i + 4)}, 8)


def test_decontaminate_items_without_id(spark):
    from terraframe.llm import decontaminate as D

    item = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(None, item), (None, "tiny"), (7, "six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "x Tiny"), (3, "x y")], "doc_id long, text string")
    got = by_id(D.find_benchmark(docs, bench))
    assert {d: (r.n_hit, r["items"], [tuple(s) for s in r.spans]) for d, r in got.items()} == {1: (9, [], [(2, 2 + len(item))]), 2: (1, [], [(2, 6)]), 3: (0, [], [])}


def test_pipeline_rejects_short_items(spark, tmp_path):
    import corpus_pipeline as P

    items = [(1, "what is the capital of zembla"), (2, "onhava"), (3, "b c d"), (4, "d e f"), (5, "f g h i"), (None, "p q r s t u v w x")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = "many other words stand here before and after it so that it is rare "
    bad = [prose + "What is the capital of Zembla? " + prose, "Onhava.", prose + "q r s t u v w x", prose + "f g h i"]
    good = [prose + "onhava " + prose, prose + "what is the capital of France", prose + "a b c d e f g z", prose, "", None]
    docs = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.decontaminate(spark, docs, str(tmp_path)).collect()) == [*range(len(good))]


def test_packing(docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from terraframe.llm.packing import Tokens, pack

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack(docs).collect()
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d, t, *_ in docs.collect():
        own = sorted(pieces[d], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == slow.encode(t or "", add_special_tokens=False).ids + [1] and own[0].doc_tokens == len(ids)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert pack(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and pack(none).count() == 0
    fast, r = Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(4)
    parts = ["a", "é", "漢", " ", "  ", "\n", "\t", ",", ".", "'s", "1", "²", "_", "word", "Don't", "🙂", "<|endoftext|>", "\x1c", " "]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert np.frombuffer(fast.encode(x), "<u4").tolist() == slow.encode(x, add_special_tokens=False).ids, x


def test_quality(docs, rows, odd, none):
    from terraframe.llm.quality import judge

    got = by_id(judge(docs))
    for d, t, *_ in rows:
        t = t or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n, cover = collections.Counter(g), set()
        for i, x in enumerate(g):
            cover |= {i, i + 1, i + 2} if n[x] > 1 else set()
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert judge(odd).count() == odd.count() and judge(none).count() == 0


def test_jensen_shannon(spark):
    from pyspark.sql import functions as F

    from terraframe.llm.quality import jsd

    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([1.0], [0.5, 0.5])], "p array<double>, q array<double>")
    a, b, c = (r[0] for r in d.select(jsd(F.col("p"), F.col("q"))).collect())
    assert a == pytest.approx(1) and b == pytest.approx(0) and c == pytest.approx((0.5 * np.log2(4 / 3) + 0.25 * np.log2(2 / 3) + 0.25) ** 0.5)


def test_secrets(docs, rows, odd, none):
    from terraframe.llm import secrets as S

    got = by_id(S.find_secrets(docs))
    total = 0
    for d, t, *_ in rows:
        want = sorted((m.start(), i, m.end()) for i, r in enumerate(S.RULES) for m in re.finditer(r.pattern, t or "") if len(m[r.group]) >= r.least)
        assert [tuple(s) for s in got[d].spans] == want
        total += len(want)
    assert total >= 6
    assert S.find_secrets(odd).count() == odd.count() and S.find_secrets(none).count() == 0
    assert S.trigram_query("[0-9a-f]{24,}") is True and S.trigram_query("AKIA[A-Z0-9]+") == ("and", frozenset({"aki", "kia"}))
    assert S.trigram_query("(abc|xyz)d?") == ("or", frozenset({"abc", "xyz"}))


def test_segments():
    from terraframe.llm.toxicity import segments, sparse_segments

    r = random.Random(3)
    for _ in range(300):
        x = [r.choice([-2.0, -1.0, -0.5, 1.0, 2.0]) for _ in range(r.randrange(1, 25))]
        best = max([0.0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)])
        got = segments(x)
        assert max([0.0] + [s for *_, s in got]) == pytest.approx(best)
        for s, e, v in got:
            assert v == pytest.approx(sum(x[s:e])) and all(sum(x[s:k]) > 0 and sum(x[k:e]) > 0 for k in range(s + 1, e))
    assert sparse_segments([3, 4, 9], [1.0, 1.0, 0.25], -0.5) == [(3, 5, 2.0), (9, 10, 0.25)]


def brute_toxicity(docs, labels, asked, most):
    """Scores of asked by the module's formulas, with nothing shared: all labelled texts of the training folds."""
    from terraframe.llm import toxicity as X

    toxic = {}
    for d, _, t in labels:
        if d is not None and t is not None and zlib.crc32(str(d).encode()) % 5:
            toxic[d] = max(toxic.get(d, 0), t)
    train = {}
    for d, t in docs:
        if d in toxic and t is not None:
            train[d] = min(train.get(d, t), t)
    assert len(train) <= most
    words = lambda t: re.findall(r"[a-z0-9'\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = lambda w: [w[:k] + "*" for k in (4, 6, 8) if len(w) >= k] + [w]
    pairs = [(p, d, w) for d, t in train.items() for w in set(words(t)) for p in own(w)]

    def rate(w, without=None):
        base = [toxic[d] for d, t in train.items() for _ in set(words(t))]
        base = sum(base) / len(base)
        r, last = base, -1
        for p in own(w):
            held = [d for q, d, _ in pairs if q == p]
            if len(held) < 2 or len(held) == last:
                continue
            last = len(held)
            held = [d for d in held if d != without]
            r = (sum(toxic[d] for d in held) + X.PRIOR * r) / (len(held) + X.PRIOR)
        return min(X.CLIP, max(0.0, np.log(r / (1 - r)) - np.log(base / (1 - base))))

    def stat(text, without=None):
        known = {w: rate(w, without) + X.DRIFT for w in set(words(text))}
        x = [known[w] for w in words(text)]
        good = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if all(sum(x[i:k]) > 0 for k in range(i + 1, j + 1)) and all(sum(x[k:j]) > 0 for k in range(i, j))]
        return sum(sum(x[i:j]) for i, j in good if not any((a <= i and j <= b) and (a, b) != (i, j) for a, b in good)) / (len(x) + 10) ** 0.5

    fit = [(round(min(40.0, stat(t, d)) * 50) / 50, toxic[d]) for d, t in train.items()]
    slope, bias = X.logistic(np.array([a for a, _ in fit]), np.array([float(b) for _, b in fit]), np.ones(len(fit)))
    return {d: 1 / (1 + np.exp(-max(-30.0, min(30.0, slope * stat(t) + bias)))) for d, t in asked}


def test_toxicity_equals_brute_force(spark):
    from terraframe.llm.toxicity import LABELLED, logistic, score_toxicity, train

    r = random.Random(8)
    prose = lambda n: [r.choice(WORDS) + str(r.randrange(9)) for _ in range(n)]
    docs, labels = [], []
    for i in range(60):
        w = prose(r.randrange(5, 30))
        if i % 4 == 0:
            for _ in range(r.randrange(1, 6)):
                w.insert(r.randrange(len(w)), r.choice(["grumpf", "grumpfig", "Grumpfe", "vile", "éclat"]) + r.choice(["", "s", "7"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1, "alpha1 a smaller text"), (3, None), (None, "grumpf grumpf"), (70, ""), (71, None), (72, "grumpf vile " * 40), (73, docs[0][1]), (73, docs[0][1])]
    labels += [(2, 1, 1), (2, 1, 0), (None, 1, 1), (5, 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = collections.Counter((x.doc_id, round(x.score, 9)) for x in score_toxicity(d, train(d, lab)).collect())
    want = brute_toxicity(docs, labels, [*enumerate(t for _, t in docs)], LABELLED)
    assert got == collections.Counter((x, round(float(want[i]), 9)) for i, (x, _) in enumerate(docs))
    assert len({s for _, s in got}) > 10
    few = train(d, lab, most=30)  # the bound on labelled rows
    assert few.both and few.odds != train(d, lab).odds
    x, y, w = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.array([5.0, 1.0, 2.0, 4.0])
    a, b = logistic(x, y, w)
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs((w * (y - p) * x).sum() - 1e-3 * a) < 1e-6 and abs((w * (y - p)).sum() - 1e-3 * b) < 1e-6


def test_toxicity_held_out(spark, odd, none):
    from terraframe.llm.toxicity import score_toxicity, train

    sf = f"{DATA}/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    rank = got.score.rank()
    pos = got.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    print("held-out AUC", auc, "accuracy", ((got.score >= 0.5) == pos).mean(), len(got))
    assert auc > 0.85
    model = train(d.limit(0), labels)
    assert score_toxicity(odd, model).filter("score <> 0").count() == 0 and score_toxicity(none, model).count() == 0


def test_toxicity_recall_by_language(spark):
    sf = f"{DATA}/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    recall = got[got.toxic == 1].groupby("lang").predicted.agg(["mean", "sum", "count"])
    clean = got[got.toxic == 0].predicted
    rank, pos = got.score.rank(), got.toxic == 1
    print(recall, "wrong", clean.sum(), "of", len(clean), "AUC", (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()), "accuracy", (got.predicted == got.toxic).mean())
    assert recall["mean"].min() > 0.6 and clean.mean() < 0.02


def test_toxicity_sums_segments_and_backs_off(spark):
    from terraframe.llm.toxicity import score_toxicity, train

    r = random.Random(1)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    vile = lambda: f"{prose(30)} grumpf{r.randrange(10**6)} {prose(30)}"  # noqa: E731  (no whole word twice)
    rows = [(i, " ".join(vile() for _ in range(4)) if i % 5 == 0 else prose(250), int(i % 5 == 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    asked = [(1, f"{prose(120)} grumpfa {prose(120)}"), (2, f"{prose(60)} grumpfb {prose(60)} grumpfc {prose(60)} grumpfd {prose(60)}"), (3, prose(240))]
    got = {x.doc_id: x.score for x in score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got[3] < got[1] < got[2] and got[2] > 0.5 > got[3]


def test_pipeline_stages_equal_brute_force(spark, docs, rows, tmp_path):
    import corpus_pipeline as P
    from terraframe.llm.quality import judge

    t = texts()
    items = [(1, " ".join(t[14].split()[5:30])), (2, "TWO, words!"), (3, None), (4, t[13]), (5, " ".join(t[19].split()[100:105]))]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = lambda d: {r.doc_id: (r.text, r.n_chars) for r in d.collect()}
    every = {d: (x, n) for d, x, _, _, n, *_ in rows}
    verdict = {r.doc_id for r in judge(docs).filter("kept").collect()}  # held against SQL by op9
    assert kept(P.quality(spark, docs, str(tmp_path))) == {d: every[d] for d in verdict} and verdict
    want = {d: (x, len(x)) if gone else (x, every[d][1]) for d, x, _, gone in brute_lines(rows)}
    assert kept(P.lines(spark, docs, str(tmp_path))) == want
    assert kept(P.near(spark, docs, str(tmp_path))) == {d: every[d] for d, (_, _, k) in brute_near(rows, 5).items() if k}
    norm = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
    clean = set()
    for d, x, *_ in rows:
        w, longest = " " + " ".join(norm(x)) + " ", 0
        for _, y in items:
            v = norm(y)
            n = min(8, len(v))
            if v and any(" " + " ".join(v[k : k + n]) + " " in w for k in range(len(v) - n + 1)):
                longest = max(longest, n)
        if longest < 4 and (not longest or 2 * longest < len(norm(x))):
            clean.add(d)
    assert kept(P.decontaminate(spark, docs, str(tmp_path))) == {d: every[d] for d in clean} and len(clean) < len(rows) - 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = [(10**6 + i, r.text + "\n" + docs.filter(f"doc_id = {i}").first().text, "en", "s", 1) for i, r in enumerate(bench.limit(3).collect())]
    every = docs.unionByName(spark.createDataFrame(leaks, docs.schema))
    d = every
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in d.collect()}
        d = stage(spark, d, SF).cache()
        after = {r.doc_id: r.text for r in d.collect()}
        assert d.columns == docs.columns and set(after) <= set(before), name
        if name == "decontaminate":
            assert not {x[0] for x in leaks} & set(after) and len(after) > 0.9 * len(before) - 3
        if name == "line_dedup":
            assert len(after) == len(before)
    assert {r.doc_id for r in P.packing(spark, d, SF).select("doc_id").collect()} == set(after)
    for _, stage in P.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0

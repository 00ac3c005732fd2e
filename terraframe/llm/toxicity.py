"""Toxicity: maximum-scoring segments of token log-odds, summed over a document.

Training: at most LABELLED labelled documents (those with the smallest hashes of their ids), the held-out fold left out. This bound on
labelled rows is the only one: every piece that two (document, distinct word) pairs or more hold is learnt. A word's pieces are its
prefixes of PREFIXES letters and the word itself. Each piece's counts are the pairs of toxic and of other documents it covers; its share
of toxic ones is shrunk by a Dirichlet prior of PRIOR pairs spread as its next shorter piece's share is, the shortest one's as that of
all pairs (a piece that covers no less than its shorter one says nothing new). So a word never seen is judged by the longest prefix
known, and rare pieces count as far as they are seen. A word scores its piece's log-odds against the common share, between 0 and CLIP,
plus DRIFT, so that a segment's expected score is negative.

Scoring: one linear pass over a text finds all maximal scoring segments (each run of tokens whose every prefix and suffix has a
positive sum, none extensible). The document's statistic is the sum of all its segments' scores by the root of its length, and its
score a logistic curve over that, fitted to histograms of both classes in training. Each training text is scored with its own counts
taken out of the model, so that the curve is fitted to texts which didn't train the odds that score them.

Segments are set against chance one by one: among clean training texts of n tokens the best segment's score S follows an extreme-value
law with scale 1/lambda and location growing as ln n. Lambda and K are fitted to the clean training texts' best scores (moments of
S - ln(n)/lambda, in a few rounds). The evidence is E = lambda S - ln(K n): -ln of the expected number of such segments by chance. A
segment is reported as significant from E of ln(1/ALPHA).

Size: the ids of the sample are LABELLED at most, so they are broadcast and no text is shuffled to meet labels; the sample's texts, the
counts of their pieces and the model are bounded by it, whatever the size of the tables.

Nulls and odd inputs: labels with a null doc_id or toxic are left out; of several labels of one document, toxic wins; of several texts
under one labelled doc_id, the smallest is learnt. Null or empty text, and text without tokens, has no segment; its score is the curve
at no evidence, below one half. A null doc_id is scored and not held out. Without labels of both classes every score is 0. Repeated rows
are each scored; empty tables work. Other columns pass through; of columns named as the results are, the results' win.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER, slices, table, use_repo

PRIOR, PREFIXES, DRIFT, CLIP, ALPHA = 20.0, (4, 6, 8), -1.0, 4.0, 0.01
LABELLED, FOLDS, MEMO = 20_000, 5, 200_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("evidence", T.DoubleType())]))
RESULTS = {"score": T.DoubleType(), "segments": SPANS}
_WORD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 39 else 32 for c in LOWER)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words: ASCII letters, digits, apostrophes and everything beyond ASCII."""
    return (text or "").encode().translate(_WORD).split()


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence, in order; linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum up to its end
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, left = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, left, total))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - lo) for s, e, lo, r in found]


def sparse_segments(hits: list[int], values: list[float], drift: float) -> list[tuple[int, int, float]]:
    """As segments(), of a sequence that is drift everywhere but at hits; work by hits, not by tokens."""
    scores: list[float] = []
    place: list[int] = []
    last = -1
    for i, v in zip(hits, values):
        if i - last > 1:
            scores.append(drift * (i - last - 1))
            place.append(last + 1)
        scores.append(v)
        place.append(i)
        last = i
    return [(place[s], place[e - 1] + 1, v) for s, e, v in segments(scores)]


def pieces(word: str) -> list[str]:
    """From general to particular: prefixes, marked by a star, which no word holds, then the word."""
    return [f"{word[:k]}*" for k in PREFIXES if len(word) >= k] + [word]


def log_odds(own: list[str], counts: dict[str, tuple[int, int]], base: float, less: dict[str, int] | None = None, toxic: int = 0) -> float:
    """Of the last of pieces of a word, against base; less: what to take from the counts of the class toxic."""
    rate, last = base, -1
    for p in own:
        a, b = counts.get(p, (0, 0))
        if not a + b or a + b == last:
            continue
        last = a + b
        if less is not None:
            a, b = a - toxic * less[p], b - (1 - toxic) * less[p]
        rate = (a + PRIOR * rate) / (a + b + PRIOR)
    return max(0.0, min(CLIP, math.log(rate / (1 - rate)) - math.log(base / (1 - base)))) if 0 < rate < 1 else 0.0


def known_odds(counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """The log-odds of each piece. A piece without any, below pieces without any, is as good as unknown and left out."""
    out = {}
    for p in counts:
        own = pieces(p)
        if p.endswith("*"):
            own = [*own[: PREFIXES.index(len(p) - 1)], p]
        if any(odds := [log_odds(own[: i + 1], counts, base) for i in range(len(own))]):
            out[p] = odds[-1]
    return out


@dataclass
class Model:
    odds: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    bias: float = -5.0
    both: bool = True
    memo: dict[bytes, float] = field(default_factory=dict, repr=False)

    def word(self, w: bytes) -> float:
        if (v := self.memo.get(w)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            v = self.memo[w] = next((self.odds[p] for p in reversed(pieces(w.decode())) if p in self.odds), 0.0)
        return v

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        return found([*map(self.word, tokens(text))])

    def evidence(self, n: int, s: float) -> float:
        return self.lam * s - math.log(self.k * max(n, 1))

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.bias)))) if self.both else 0.0


def found(odds: list[float]) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens and segments of a text, given its tokens' log-odds."""
    hits = [i for i, v in enumerate(odds) if v > 0]
    return len(odds), sparse_segments(hits, [odds[i] + DRIFT for i in hits], DRIFT) if hits else []


def statistic(n: int, spans: list[tuple[int, int, float]]) -> float:
    """Of all segments of a text of n tokens."""
    return sum(v for *_, v in spans) / math.sqrt(n + 10)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents a token, by class: partial sums of a bounded number of tokens at a time."""
    schema = pa.schema([("token", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])
    counts = (Counter(), Counter())

    def flush():
        every = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(every, pa.binary()).cast(pa.string()), pa.array([counts[1][w] for w in every], pa.int64()), pa.array([counts[0][w] for w in every], pa.int64())], schema=schema)
        counts[0].clear(), counts[1].clear()
        return out

    for b in it:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts[toxic].update({*tokens(text)})
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush()
    yield flush()


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = LABELLED) -> DataFrame:
    """text and toxic (0 or 1) of at most `most` labelled documents outside of the held-out fold."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    own = own.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    own = own.groupBy("doc_id").agg(F.when(F.max("toxic") > 0, 1).otherwise(0).alias("toxic"))
    own = own.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    kept = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # `most` rows at most
    return kept.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).drop("doc_id")


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = LABELLED) -> Model:
    spark = docs.sparkSession
    use_repo(spark)
    rows = table(training_rows(docs, labels, folds, most), "train")
    every = [F.when(F.length("token") >= k, F.concat(F.substring("token", 1, k), F.lit("*"))) for k in PREFIXES]
    # the empty piece counts all pairs
    counts = rows.mapInArrow(_count, "token string, toxic long, other long").select(F.explode(F.array(*every, F.col("token"), F.lit(""))).alias("piece"), "toxic", "other").filter("piece is not null")
    counts = counts.groupBy("piece").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    counts = table(counts.filter("a + b >= 2"), "counts")
    t = counts.toArrow()  # of a bounded number of texts
    known = dict(zip(t["piece"].to_pylist(), zip(t["a"].to_pylist(), t["b"].to_pylist())))
    toxic, other = known.pop("", (0, 0))
    if not toxic or not other:
        return Model({}, both=False)
    base = toxic / (toxic + other)
    held = spark.sparkContext.broadcast(known)

    def tops(it):
        known = held.value
        for b in it:
            out = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                own = {w: pieces(w.decode()) for w in {*words}}
                less = Counter(p for ps in own.values() for p in ps)
                odds = {w: log_odds(ps, known, base, less, toxic) for w, ps in own.items()}
                n, spans = found([odds[w] for w in words])
                out.append((n, max((v for *_, v in spans), default=0.0), statistic(n, spans)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.float64()), b.column(1).cast(pa.int32())], names=["n", "s", "x", "toxic"])

    best_of = table(rows.mapInArrow(tops, "n long, s double, x double, toxic int"), "tops")
    lam = 1.0
    for _ in range(8):  # scale and place of an extreme-value law, by moments, of clean texts
        g = F.col("s") - F.log(F.greatest("n", F.lit(1))) / lam
        m, sd = best_of.filter("toxic = 0").agg(F.avg(g), F.stddev_pop(g)).first()
        new = math.pi / math.sqrt(6) / max(sd or 0.0, 0.05)
        if abs(new - lam) < 1e-3 * lam:
            break
        lam = new
    model = Model(known_odds(known, base), lam, math.exp(lam * (m or 0.0) - 0.5772156649))
    bins = best_of.groupBy(F.round(F.least(F.lit(40.0), F.col("x")) * 50).alias("bin"), "toxic").count().collect()
    x = np.array([r["bin"] / 50 for r in bins])
    y = np.array([float(r["toxic"]) for r in bins])
    w = np.array([float(r["count"]) for r in bins])
    model.slope, model.bias = logistic(x, y, w)
    held.unpersist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve by Newton's method, lightly regularised."""
    t = np.zeros(2)
    f = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ t, -30, 30)))
        grad = f.T @ (w * (y - p)) - 1e-3 * t
        step = np.linalg.solve((f * (w * p * (1 - p))[:, None]).T @ f + np.eye(2) * 1e-3, grad)
        t = t + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def score_toxicity(docs: DataFrame, model: Model, with_segments: bool = True) -> DataFrame:
    """docs with score (0 to 1) and segments: significant passages as token numbers [start, end) and evidence."""
    spark = docs.sparkSession
    use_repo(spark)
    shared = spark.sparkContext.broadcast(model)
    base = docs.select(*[c for c in docs.columns if c not in RESULTS])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.schema] + [T.StructField(n, t) for n, t in RESULTS.items()])
    arrow = to_arrow_schema(schema)
    least = math.log(1 / ALPHA)

    def run(it):
        m = shared.value
        for b in slices(it):
            scores, spans = [], []
            for t in b.column("text").to_pylist():
                n, every = m.find(t)
                scores.append(m.score(statistic(n, every)))
                spans.append([{"start": s, "end": e, "evidence": ev} for s, e, v in every if (ev := m.evidence(n, v)) >= least] if with_segments else [])
            new = {"score": scores, "segments": spans}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else b.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return base.mapInArrow(run, schema)

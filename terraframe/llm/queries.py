"""The queries over the operators, by name: each takes (spark, sf_dir) and returns the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    read = read_archives(write_archives(_read(spark, sf_dir, "pages")), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import FOLDS, score_toxicity, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, _read(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("segments").cast("long").alias("n_segments"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents"), min_chars=40, min_docs=5, digest_only=True)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_benchmark

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, _read(spark, sf_dir, "benchmark"), 8, with_spans=False)
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), with_ids=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    d = judge(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_text=False)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, RULES, find_secrets

    d = find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.array(*[F.lit(r.kind) for r in RULES])
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda i: F.filter("spans", lambda x: x["kind"] == i)  # noqa: E731  (a second parameter would be an index)
    counts = [F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return d.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_bytes

    return dedup_bytes(_read(spark, sf_dir, "documents"), digest_only=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_dedup import dedup_words

    return dedup_words(_read(spark, sf_dir, "documents"), digest_only=True)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import link_components

    return link_components(_read(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}

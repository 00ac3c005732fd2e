"""From documents to packed training sequences: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of documents, as
they come in; text and n_chars change where a stage cuts lines. Empty tables pass through every stage; nulls are handled as the
operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm.common import shared_dir, table
from terraframe.llm.decontaminate import find_benchmark
from terraframe.llm.line_dedup import dedup_lines
from terraframe.llm.near_dedup import near_dedup
from terraframe.llm.packing import pack
from terraframe.llm.quality import judge

WINDOW, SHORT = 8, 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose histograms are near their language's."""
    others = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*others).alias("row"), "doc_id", "text", *["lang"] * ("lang" in docs.columns))
    return judge(own).filter("kept").select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the largest doc_id holding them; n_chars follows the text."""
    others = [c for c in docs.columns if c != "text"]
    cut = dedup_lines(docs.select("doc_id", "text", F.struct(*others).alias("row")))
    size = {"n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in others else {}
    return cut.select(*[F.col("text") if c == "text" else size.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of eight words of an item, nor an item of four to seven words whole. A still shorter item turns up
    in clean documents by chance, so it only rejects one of whose words it makes up at least half."""
    others = [c for c in docs.columns if c != "text"]
    own = docs.select("doc_id", "text", F.struct(*others).alias("row"))
    found = find_benchmark(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW, with_spans=False, longest=True)
    n = F.col("longest")
    clean = found.filter((n < SHORT) & ((n == 0) | (2 * n < F.col("n_words"))))
    return clean.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The near-dedup and packing stages aren't expressible in SQL; the tests hold quality against SQL, packing against an exact round trip and
#: the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name, folder)
    return STAGES[-1][1](spark, docs, sf_dir)

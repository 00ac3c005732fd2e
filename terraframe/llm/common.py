"""Shared plumbing of the corpus operators: the cluster's shared folder, tables in it, and word splitting."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

#: A-Z to a-z; every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Stands for a null doc_id: it sorts behind every other document.
NULL_ID = np.iinfo(np.int64).max


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors reach, below spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/tf-{uuid.uuid4().hex}"


def fs_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes | Iterable[bytes]) -> None:
    """Writes under a name of this attempt, then renames: a repeated task leaves the same file, never half of one."""
    fs, path = fs_of(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)
    fs.move(temp, path)


def read_file(uri: str) -> bytes:
    fs, path = fs_of(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and returns what was written."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, whatever else docs has."""
    return docs.select(*[docs[c] for c in columns])


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and an executor's other tasks need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(it: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that the Python objects made of one are few."""
    try:
        for b in it:
            for k in range(0, b.num_rows, rows):
                yield b.slice(k, rows)
    finally:
        give_back()


class WordHash(dict):
    """64-bit hashes of words, kept for the words seen most recently; its size is bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def use_repo(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed on them, as in local mode."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)

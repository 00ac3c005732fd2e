"""Bounded-space online packing of token sequences into windows of a fixed size.

Each partition streams its documents and keeps OPEN windows. A document is cut at full windows; its rest goes to the open
window that it fills best. If it fits none, the fullest is emitted as it is and a new one opened. At the end of a partition its
open windows are left over. Only their descriptions (document, start, length) travel on: groups of GROUP partitions merge
theirs, best fit by falling length, so that a merge task gets at most GROUP * OPEN windows.

Token ids are those of the tokenizers library with the file at tokenizer_path and add_special_tokens=False, then EOS. Its
encoder takes over four times as long as tiktoken; so a text is split at single blanks, where this vocabulary's pattern always splits too,
and each word is looked up in a bounded cache, misses being encoded by tiktoken with the same vocabulary. Texts in which a split
isn't certain (runs of white space, white space at an end, kinds other than blanks and line ends) are encoded whole by tiktoken,
and texts holding a special token's string by tokenizers. The tests hold both ways against tokenizers.

Nulls and odd inputs: a null or empty text is the end token alone. A null doc_id stays null; rows with one doc_id are packed
each for itself. An empty table gives an empty result. Columns of docs other than doc_id and text are left out.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, shared_dir, slices, table, use_repo

EOS, SIZE, OPEN, GROUP = 1, 2048, 64, 64
CACHE = 800_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, seq long, offset long, used long, ids binary"


class Unsure(Exception):
    """A split of the text at blanks isn't certain to be one of its tokens."""


class Pieces(dict):
    """Ids of words with the blank before them, by word; bounded."""

    def __init__(self, raw, before: str = " "):
        super().__init__()
        self.raw, self.before = raw, before
        self.starts = Pieces(raw, "") if before else self  # words at the beginning of a line
        self.newline, self.ends = raw("\n"), {c: raw(c) for c in ",."}

    def __missing__(self, word: str) -> bytes:
        parts = word.split()
        if len(parts) == 1 and parts[0] == word:
            if len(self) >= CACHE:
                self.clear()
            if word[-1] in ",." and word[-2:-1].isalnum():  # a token of its own behind a letter or digit
                x = self[word[:-1]] + self.ends[word[-1]]
            else:
                x = self.raw(self.before + word)
            if len(word) < 64:
                self[word] = x
            return x
        if parts and "\n".join(parts) == word:  # words on both sides of single line ends
            return self[parts[0]] + b"".join(self.newline + self.starts[x] for x in parts[1:])
        raise Unsure


class Tokens:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.get = Pieces(self._raw).__getitem__

    def _raw(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if not first or first.split() != [first]:
            return self._raw(text)
        try:
            return self._raw(first) + b"".join(map(self.get, rest))
        except Unsure:
            return self._raw(text)


class Windows:
    """The open windows of one partition."""

    def __init__(self, part: int, size: int, count: int):
        self.part, self.size, self.count = part, size, count
        self.open: dict[int, list] = {}  # seq: [used, pieces]
        self.seq = 0

    def _new(self) -> int:
        self.seq += 1
        self.open[self.seq] = [0, []]
        return self.seq

    def add(self, piece: tuple, length: int) -> list[tuple]:
        """Places a piece, gives the pieces of windows that are ready."""
        done: list[tuple] = []
        fits = [(w[0], s) for s, w in self.open.items() if w[0] + length <= self.size]
        if fits:
            s = max(fits)[1]
        else:
            if len(self.open) >= self.count:
                done += self._emit(max((w[0], k) for k, w in self.open.items())[1])
            s = self._new()
        w = self.open[s]
        w[1].append((*piece, s, w[0]))
        w[0] += length
        if w[0] == self.size:
            done += self._emit(s)
        return done

    def _emit(self, s: int) -> list[tuple]:
        return [(*p, 0) for p in self.open.pop(s)[1]]

    def rest(self) -> list[tuple]:
        """Pieces left over, each with how full its window is."""
        return [(*p, used) for used, pieces in self.open.values() for p in pieces]


def _pack(it: Iterator[pa.RecordBatch], schema: pa.Schema, size: int, count: int, eos: int, paths: tuple, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    tokens, windows = Tokens(*paths), Windows(part, size, count)
    end = np.array([eos], "<u4").tobytes()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 9
        doc, start, length, crc, total, raw, seq, offset, used = cols
        data = {"doc_id": doc, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "part": [part] * len(rows), "seq": seq, "offset": offset, "used": used, "ids": raw}
        return pa.RecordBatch.from_arrays([pa.array(data[f.name], f.type) for f in schema], schema=schema)

    for b in slices(it):
        ready: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = tokens.encode(text or "") + end
            total = len(ids) // 4
            for start in range(0, total, size):
                raw = ids[4 * start : 4 * (start + size)]
                ready += windows.add((doc, start, len(raw) // 4, zlib.crc32(raw), total, raw if with_ids else None), len(raw) // 4)
        yield out(ready)
    yield out(windows.rest())


def _merge(pdf, size: int):
    """Leftover windows of a group of partitions, largest first, each into the fullest window that still takes it."""
    import bisect

    sizes = pdf.groupby(["part", "seq"], sort=True)["used"].first().sort_values(ascending=False, kind="stable")
    room: list[tuple[int, int]] = []  # free tokens, number of the merged window; sorted
    place: dict[tuple, tuple[int, int]] = {}
    for key, used in sizes.items():
        i = bisect.bisect_left(room, (used, -1))
        free, seq = room.pop(i) if i < len(room) else (size, len(place))
        place[key] = (seq, size - free)
        if free > used:
            bisect.insort(room, (free - used, seq))
    at = [place[k] for k in zip(pdf["part"], pdf["seq"])]
    pdf["seq"], pdf["offset"] = [s for s, _ in at], [a + o for (_, a), o in zip(at, pdf["offset"])]
    return pdf


def pack(docs: DataFrame, size: int = SIZE, open_windows: int = OPEN, eos: int = EOS, tokenizer_path: str | None = None, ranks_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (with_ids) ids, little-endian
    unsigned 32-bit. Paths: the vocabulary for tokenizers, and the same as ranks for tiktoken; by default those of
    public_tokenizers. See the module for the method and for nulls."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    use_repo(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(PIECES)
    arrow = to_arrow_schema(schema)
    paths = (tokenizer_path, ranks_path)
    pieces = table(only(docs, "doc_id", "text").mapInArrow(lambda it: _pack(it, arrow, size, open_windows, eos, paths, with_ids), schema), "pieces", shared_dir(spark))
    full = pieces.filter("used = 0").withColumn("sequence_id", F.shiftleft("part", 32) + F.col("seq"))
    left = pieces.filter("used > 0").withColumn("team", F.expr(f"part div {GROUP}"))
    merged = left.groupBy("team").applyInPandas(lambda pdf: _merge(pdf, size), left.schema)
    merged = merged.withColumn("sequence_id", F.lit(1 << 62) + F.shiftleft("team", 32) + F.col("seq"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return full.select(columns).unionByName(merged.select(columns))

"""Spark data sources: o5m, osm_xml, osm_change and osm_pbf, read and written; o5m and PBF are read by segment and by blob.

Rows pass between Spark and the codecs as Arrow batches, column by column (batches.py).

Reading: option "table" picks objects (default), bounds or header. XML is read by runs of the root's children (xml.pieces). seq is the partition's number in its upper bits and the place in
it in its lower ones, so it keeps the order of a file across partitions. Files of a folder, or one file, are read; names are those
that Python on every executor can open (a local or mounted path).

Writing: each task writes its rows as a part in the order it gets them; committing joins the parts in the order of partitions to one
file. Sort first (io.write_osm does). PBF parts are blobs, o5m parts are segments behind a reset, XML parts are elements, so tasks
don't depend on each other.
"""

from __future__ import annotations

import json
import mmap
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyarrow import RecordBatch
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schema as S
from . import batches, o5m, pbf, xml

CHUNK, PIECE, MOST_PIECES = 1 << 20, 256 << 10, 512


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_")))
    return [path]


def _bytes(path: str, begin: int = 0, size: int = -1) -> bytes:
    with open(path, "rb") as f:
        f.seek(begin)
        return f.read(size)


@contextmanager
def _mapped(path: str) -> Iterator[bytes | mmap.mmap]:
    """A file's bytes as far as they are looked at: planning steps from record to record and holds none of them."""
    with open(path, "rb") as f:
        if os.fstat(f.fileno()).st_size == 0:
            yield b""
            return
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
            yield m


@dataclass
class Piece(InputPartition):
    number: int
    path: str
    begin: int = 0
    end: int = -1
    root: int = 0
    blocks: int = 0

    def __init__(self, number: int, path: str, begin: int = 0, end: int = -1, root: int = 0, blocks: int = 0):
        """Of XML read by pieces, root: bytes of the file up to the end of the root's tag; blocks: children of the root before begin."""
        super().__init__(number)
        self.number, self.path, self.begin, self.end, self.root, self.blocks = number, path, begin, end, root, blocks


class _Reader(DataSourceReader):
    change = False

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.what = options.get("table", "objects")
        self.types = set(filter(None, options.get("types", "").split(",")))

    def pieces(self, path: str) -> list[tuple[int, ...]]:
        return [(0, -1)]

    def events(self, piece: Piece) -> Iterator[tuple]:
        raise NotImplementedError

    def partitions(self) -> list[Piece]:
        out: list[Piece] = []
        for path in _files(self.options["path"]):
            for place in self.pieces(path):
                out.append(Piece(len(out), path, *place))
        return out

    def read(self, partition: Piece) -> Iterator[RecordBatch]:
        return batches.of_rows(self.rows(partition), self.schema)

    def rows(self, partition: Piece) -> Iterator[dict]:
        place = partition.number << 40
        for kind, *value in self.events(partition):
            place += 1
            if kind == "object" and self.what == "objects" and (not self.types or value[0]["type"] in self.types):
                row = value[0] | {"seq": place}
            elif kind == "bounds" and self.what == "bounds":
                row = dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), value[0])) | {"seq": place}
            elif kind == "header" and self.what == "header":
                row = {"writing_program": "", "required_features": [], **value[0]}
            else:
                continue
            yield row


def _plain(field: str, v):
    return [(m["type"], m["ref"], m["role"]) for m in v] if field == "members" and v is not None else v


def _grouped(places: Iterable[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Neighbours as pieces of PIECE bytes at least, and not many more pieces than MOST_PIECES."""
    out, begin, least = [], None, max(PIECE, size // MOST_PIECES)
    for at, end in places:
        begin = at if begin is None else begin
        if end - begin >= least:
            out.append((begin, end))
            begin = None
    return out if begin is None else [*out, (begin, end)]


class O5mReader(_Reader):
    def pieces(self, path: str) -> list[tuple[int, int]]:
        with _mapped(path) as data:
            o5m.check(data)
            return _grouped(o5m.runs(data, 1, len(data)), len(data))

    def events(self, piece: Piece) -> Iterator[tuple]:
        strict = self.options.get("strictroles", "false") == "true"
        with _mapped(piece.path) as data:
            for begin, end in o5m.runs(data, piece.begin, piece.end):
                own = data[begin:end]
                yield from o5m.Decoder(strict).records(own, 0, len(own))


class PbfReader(_Reader):
    def pieces(self, path: str) -> list[tuple[int, int]]:
        with _mapped(path) as data:
            ends = [0, *(at + size for _, at, size in pbf.blobs(data))]
            return _grouped(zip(ends, ends[1:]), len(data))

    def events(self, piece: Piece) -> Iterator[tuple]:
        data = _bytes(piece.path, piece.begin, piece.end - piece.begin)
        for kind, at, size in pbf.blobs(data):
            if kind == "OSMHeader":
                head, box = pbf.decode_header(pbf.inflate(data[at : at + size]))
                yield "header", head
                if box:
                    yield "bounds", box
            elif kind == "OSMData" and self.what == "objects":
                for row in pbf.decode_block(pbf.inflate(data[at : at + size]), self.options.get("compat") == "reference"):
                    yield "object", row


def _chunks(path: str, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
    with open(path, "rb") as f:
        f.seek(begin)
        while c := f.read(CHUNK if end is None else min(CHUNK, end - f.tell())):
            yield c


class XmlReader(_Reader):
    def limits(self) -> dict:
        return {k: v for k, v in self.options.items() if k.startswith("max_")}

    def permissive(self) -> bool:
        return self.options.get("mode", "").upper() == "PERMISSIVE"

    def pieces(self, path: str) -> list[tuple[int, ...]]:
        """What counts from the start of a file, limits and the place of an error that is passed over, needs it whole."""
        if self.permissive() or any(xml.parse_limits(self.limits()).values()):
            return [(0, -1)]
        with _mapped(path) as data:
            return xml.pieces(data) or [(0, -1)]

    def events(self, piece: Piece) -> Iterator[tuple]:
        if piece.begin == piece.root:
            yield "header", {"is_diff": False, "file_type": "osm"}
        if piece.end < 0:
            yield from xml.decode(_chunks(piece.path), self.change, self.limits(), self.permissive())
        else:
            last = piece.end == os.path.getsize(piece.path)
            yield from xml.decode_piece(_bytes(piece.path, 0, piece.root), _chunks(piece.path, piece.begin, piece.end), last, self.change)


def change_rows(events: Iterator[tuple], first_only: bool = False, before: int = 0) -> Iterator[tuple[str, dict]]:
    """("block", row) and ("object", row) of the events of a change file, or of a piece of it with so many blocks before."""
    block, pos, own = before - 1, 0, {}
    for kind, *value in events:
        if kind == "open":
            block, pos = block + 1, 0
            own = {"block_no": block, "action": value[0], "if_unused": value[1], "is_diff": block == 0 or not first_only}
            yield "block", own
        elif kind == "object":
            yield "object", value[0] | own | {"pos": pos}
            pos += 1


class ChangeReader(XmlReader):
    change = True

    def rows(self, partition: Piece) -> Iterator[dict]:
        for kind, row in change_rows(self.events(partition), self.options.get("compat") == "reference", partition.blocks):
            if f"{kind}s" == self.what:
                yield row


def _append(path: str, out) -> None:
    """A file's bytes behind those of out, copied by the kernel where it can."""
    out.flush()
    with open(path, "rb", buffering=0) as f:
        try:
            while os.copy_file_range(f.fileno(), out.fileno(), 1 << 30):
                pass
        except (AttributeError, OSError):
            pass
        shutil.copyfileobj(f, out, CHUNK)


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.path = options["path"].removeprefix("file://")
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.bounds = [tuple(b) for b in json.loads(options.get("bounds", "[]"))]

    def flag(self, name: str, default: bool) -> bool:
        return self.options.get(name, str(default)).lower() == "true"

    def body(self, rows: Iterator[dict]) -> Iterator[bytes]:
        raise NotImplementedError

    def head(self) -> bytes:
        raise NotImplementedError

    def tail(self) -> bytes:
        return b""

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        part = f"{self.path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(part) or ".", exist_ok=True)
        with open(part, "wb") as f:
            for b in self.body(batches.to_rows(iterator)):
                f.write(b)
        return Part(TaskContext.get().partitionId(), part)

    def commit(self, messages: list) -> None:
        temp = f"{self.path}.{uuid.uuid4().hex}"
        with open(temp, "wb") as out:
            out.write(self.head())
            for m in sorted((m for m in messages if m), key=lambda m: m.number):
                _append(m.path, out)
                os.remove(m.path)
            out.write(self.tail())
        os.replace(temp, self.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class O5mWriter(_Writer):
    def body(self, rows):
        yield from o5m.body(rows)

    def head(self) -> bytes:
        return o5m.header(self.flag("is_diff", False), self.bounds)

    def tail(self) -> bytes:
        return o5m.FOOTER


class PbfWriter(_Writer):
    def body(self, rows):
        from ..operators.core import PER_BLOCK

        o = self.options
        options = {"meta": self.flag("encode_meta_data", True), "historical": self.flag("encode_historical", False), "per_group": int(o.get("max_group_objects", pbf.PER_GROUP)), "granularity": int(o.get("granularity", 100)), "date": int(o.get("date_granularity", 1000)), "lat0": int(o.get("lat_offset", 0)), "lon0": int(o.get("lon_offset", 0))}
        most = int(o.get("max_block_objects", 0))
        own: list[dict] = []
        for r in rows:
            if own and (r["type"] != own[0]["type"] or len(own) >= (most or PER_BLOCK[own[0]["type"]])):
                yield from pbf.encode_blobs(own, self.flag("compress", True), **options)
                own = []
            own.append(r)
        yield from pbf.encode_blobs(own, self.flag("compress", True), **options)

    def head(self) -> bytes:
        head = pbf.encode_header(self.bounds[0] if self.bounds else None, self.options.get("writing_program", "terraframe"), self.flag("encode_historical", False))
        return pbf.frame("OSMHeader", head, self.flag("compress", True))


class XmlWriter(_Writer):
    def body(self, rows):
        for r in rows:
            yield xml.element(r).encode()

    def head(self) -> bytes:
        return xml.prolog(json.loads(self.options.get("attributes", "{}")), self.bounds).encode()

    def tail(self) -> bytes:
        return xml.EPILOG.encode()


class ChangeWriter(_Writer):
    """Rows must come whole blocks a partition, blocks in order (io.write_change sees to that)."""

    def body(self, rows):
        def blocks():
            own, key = [], None
            for r in rows:
                k = (r["block_no"], r["action"], bool(r["if_unused"]))
                if own and k != key:
                    yield key[1], key[2], own
                    own = []
                key = k
                own.append(r)
            if own:
                yield key[1], key[2], own

        for text in xml.change_blocks(blocks(), self.flag("separate_actions", False), self.flag("write_if_unused", False)):
            yield text.encode()

    def head(self) -> bytes:
        return next(xml.change_document([])).encode()

    def tail(self) -> bytes:
        return b"</osmChange>\n"


class _Format(DataSource):
    reader_class: type = _Reader
    writer_class: type = _Writer
    change = False

    def schema(self) -> StructType:
        what = self.options.get("table", "objects")
        if what == "blocks":
            return StructType(S.CHANGE.fields[:4])
        return {"bounds": S.BOUNDS, "header": S.HEADER}.get(what, S.CHANGE if self.change else S.OBJECT)

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reader_class(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return self.writer_class(dict(self.options), schema, overwrite)


class O5m(_Format):
    reader_class, writer_class = O5mReader, O5mWriter

    @classmethod
    def name(cls) -> str:
        return "o5m"


class Pbf(_Format):
    reader_class, writer_class = PbfReader, PbfWriter

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"


class Xml(_Format):
    reader_class, writer_class = XmlReader, XmlWriter

    @classmethod
    def name(cls) -> str:
        return "osm_xml"


class Change(_Format):
    reader_class, writer_class, change = ChangeReader, ChangeWriter, True

    @classmethod
    def name(cls) -> str:
        return "osm_change"


def register(spark) -> None:
    """Makes the formats known to a session, and this package to its Python workers."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for source in (O5m, Pbf, Xml, Change):
        spark.dataSource.register(source)

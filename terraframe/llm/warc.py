"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

An archive is a ZIP file with two stored members: archive/data.warc.gz (WARC 1.1 records, each a gzip member of its own) and indexes/index.jsonl (a line a
record: place and length within the member). The reader gets the end of the file, finds the end-of-central-directory record
(and the ZIP64 one, where a size or place is over its field), parses the central directory, reads the local header of a stored
member for the place of its data, then reads single records by range. A compressed member, a damaged directory or a member on
another disk is an error. The directory tells which members to read: all archive/*.warc.gz and all indexes/*. A line of an index may name
its member ("member", with or without archive/); else it means the member with the name of its index, or else the only one. A member
that no index covers, and a line that means none, are errors.

Records with equal payloads of at least min_revisit bytes become revisits of the one with the largest page_id. Payloads are
compared by SHA-256 while planning. Only (digest, page_id) is grouped, with partial maxima first, so that a payload that a third
of all pages share costs one row a task; pages then meet the few repeated digests over salted keys.

Nulls and odd inputs: null html is an empty payload; a null url is written as about:blank. Among equal payloads, all rows with
the largest page_id are responses if that id repeats; rows with a null page_id count as smallest. An empty table gives an empty
result. Other columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fs_of, shared_dir, table, use_repo

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
ARCHIVE_BYTES = 64 << 20
SALTS = 16
LIMIT32 = 0xFFFFFFFF


# --- ZIP -----------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, written straight through; ZIP64 fields where 32 bits don't do, or always."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> None:
        """The sizes and the checksum follow the data (bit 3), so that nothing is held or sought."""
        import zlib

        start, raw = self.at, name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, LIMIT32, LIMIT32, len(raw), len(extra)) + raw + extra)
        crc = size = 0
        for p in parts:
            self._write(p)
            crc, size = zlib.crc32(p, crc), size + len(p)
        self._write(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, start in self.members:
            big, far = self.zip64 or size >= LIMIT32, self.zip64 or start >= LIMIT32
            extra = (struct.pack("<QQ", size, size) if big else b"") + (struct.pack("<Q", start) if far else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            s = LIMIT32 if big else size
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, LIMIT32 if far else start) + raw + extra)
        length, n = self.at - begin, len(self.members)
        if self.zip64 or begin >= LIMIT32 or n >= 0xFFFF:
            place = self.at
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, begin) + struct.pack("<IIQI", 0x07064B50, 0, place, 1))
            n, length, begin = 0xFFFF, LIMIT32, LIMIT32
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, begin, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipReader:
    """Random access to the stored members of a ZIP file; f: seekable, with size."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        self.members = {m.name: m for m in self._directory()}

    def range(self, start: int, length: int) -> bytes:
        self.f.seek(start)
        data = self.f.read(length)
        if len(data) != length:
            raise ValueError(f"archive ends before byte {start + length}")
        return bytes(data)

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65557)
        tail = self.range(tail_at, self.size - tail_at)
        i = len(tail)
        while (i := tail.rfind(b"PK\x05\x06", 0, i)) >= 0:
            if i + 22 <= len(tail) and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] == len(tail):
                break
        if i < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        disk, _, here, n, length, begin, _ = struct.unpack_from("<HHHHIIH", tail, i + 4)
        at = tail_at + i
        if 0xFFFF in (n, here) or LIMIT32 in (length, begin):
            if at >= 20 and (locator := self.range(at - 20, 20))[:4] == b"PK\x06\x07":
                record = self.range(struct.unpack("<IIQI", locator)[2], 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("damaged ZIP64 end of central directory")
                disk, _, _, n, length, begin = struct.unpack_from("<IIQQQQ", record, 16)
        if disk:
            raise ValueError("archives on several disks aren't supported")
        data, p = self.range(begin, length), 0
        for _ in range(n):
            if data[p : p + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", data, p + 8)
            packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, p + 20)
            header = struct.unpack_from("<I", data, p + 42)[0]
            name, extra = data[p + 46 : p + 46 + n_name], data[p + 46 + n_name : p + 46 + n_name + n_extra]
            q = 0
            while q + 4 <= len(extra):
                tag, k = struct.unpack_from("<HH", extra, q)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, q + 4))
                    size = next(wide) if size == LIMIT32 else size
                    packed = next(wide) if packed == LIMIT32 else packed
                    header = next(wide) if header == LIMIT32 else header
                q += 4 + k
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, size, header)
            p += 46 + n_name + n_extra + n_note

    def data_at(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.range(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"damaged local header of {name}")
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        size = self.members[name].size
        length = size - start if length is None else length
        if start < 0 or start + length > size:
            raise ValueError(f"range outside of {name}")
        return self.range(self.data_at(name) + start, length)


# --- WARC ----------------------------------------------------------------------------------------


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    own = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {i}')}>"
    body = payload if kind == "response" else b""
    url = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {own(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, sep, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not sep or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("WARC record is cut short")
    return fields, rest[:n]


def _write(it: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Archives of about ARCHIVE_BYTES, under names of this attempt; those of attempts that failed are in no manifest."""
    rows = (r for b in it for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "last"))))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])
    pending = next(rows, None)
    fs, base = fs_of(folder)
    fs.create_dir(base, recursive=True)
    while pending is not None:
        name, index = f"{uuid.uuid4().hex}.zip", []

        def records():
            nonlocal pending
            at = 0
            while pending is not None and at < ARCHIVE_BYTES:
                page, url, html, digest, last = pending
                revisit = last is not None and page != last
                data = gzip.compress(record("revisit" if revisit else "response", page, url, (html or "").encode(), digest, last if revisit else None), 1, mtime=0)
                index.append((at, len(data), page))
                at += len(data)
                yield data
                pending = next(rows, None)

        with fs.open_output_stream(f"{base}/{name}") as out:
            z = ZipWriter(out)
            z.member(DATA, records())
            z.member(INDEX, (json.dumps({"offset": a, "length": n, "page_id": p}).encode() + b"\n" for a, n, p in index))
            z.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], schema=schema)


def places(z: ZipReader) -> dict[str, list[dict]]:
    """The lines of all indexes by the member they mean."""
    stem = lambda name: name.rpartition("/")[2].partition(".")[0]
    own: dict[str, list[dict]] = {m: [] for m in z.members if m.startswith("archive/") and m.endswith(".warc.gz")}
    named = {stem(m): m for m in own}
    indexed = set()
    for index in z.members:
        if not index.startswith("indexes/") or index.endswith("/"):
            continue
        alike = named.get(stem(index)) or (next(iter(own)) if len(own) == 1 else None)
        indexed.add(alike)
        for line in z.read(index).splitlines():
            x = json.loads(line)
            member = x.get("member", alike)
            member = member if member in own else f"archive/{member}"
            if member not in own:
                raise ValueError(f"a line of {index} means no member of archive/")
            own[member].append(x)
    for m, lines in own.items():
        if not lines and m not in indexed and z.members[m].size:
            raise ValueError(f"no index covers {m}")
    return own


OUT = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, path string"
READ_AHEAD = 4 << 20


def _read(it: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string())])
    for b in it:
        for path in b.column("path").to_pylist():
            fs, p = fs_of(path)
            with fs.open_input_file(p) as f:
                z = ZipReader(f, f.size())
                for member, own in places(z).items():
                    base = z.data_at(member)
                    i = 0
                    while i < len(own):  # neighbours in one range, each record then for itself
                        j, start = i, own[i]["offset"]
                        while j < len(own) and (j == i or own[j]["offset"] + own[j]["length"] - start <= READ_AHEAD) and own[j]["offset"] == (start if j == i else own[j - 1]["offset"] + own[j - 1]["length"]):
                            j += 1
                        run = z.range(base + start, own[j - 1]["offset"] + own[j - 1]["length"] - start)
                        rows = []
                        for x in own[i:j]:
                            head, body = parse(run[x["offset"] - start : x["offset"] - start + x["length"]])
                            kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and hashlib.sha1(body).hexdigest() != said:
                                raise ValueError(f"payload of page {x['page_id']} in {path} doesn't have its digest")
                            n = len(body) if kind == "response" else int(head["x-payload-length"])
                            ref = head.get("x-refers-to-page-id")
                            rows.append((int(head["x-page-id"]) if head["x-page-id"] else None, head["warc-target-uri"], kind, n, said, int(ref) if ref else None, body if with_payload else None, path))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        i = j


def write_archives(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Writes pages (page_id, url, html) to ZIP-packaged WARC files in the shared folder; gives their paths and record counts."""
    spark = pages.sparkSession
    use_repo(spark)
    folder = shared_dir(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    p = pages.select("page_id", "url", "html").withColumn("__n", F.octet_length(payload))
    p = p.withColumn("__key", F.when(F.col("__n") >= min_revisit, F.sha2(payload, 256)))
    groups = p.filter("__key is not null").groupBy("__key").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).filter("c > 1 and last is not null")
    groups = groups.select("__key", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    # rows without a key get one of their own for the join, so that null isn't one hot key
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    p = p.withColumn("__salt", salt).withColumn("__key", F.coalesce("__key", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    rows = p.join(groups, ["__key", "__salt"], "left").select("page_id", "url", "html", F.sha1(payload).alias("digest"), "last")
    return table(rows.mapInArrow(lambda it: _write(it, folder + "/zip"), "path string, records long"), "manifest", folder)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives (path): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, path. Of a
    revisit, payload is empty and payload_bytes is that of the payload it stands for."""
    use_repo(manifest.sparkSession)
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(width, "path").mapInArrow(lambda it: _read(it, with_payload), OUT)

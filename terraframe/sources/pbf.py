"""The PBF format: blobs of protocol buffer messages, each with its own string table, so each can be read and written by itself."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

from ..schema import blank
from .wire import Reader, message, packed, put, signed32, signed64, unpacked, utf8, varint, zigzag

MOST_PAYLOAD, MOST_HEADER, PER_GROUP = 32 << 20, 64 << 10, 8000
KINDS = ("node", "way", "relation")


def blobs(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(type, place, size) of each blob, without reading it."""
    r = Reader(data)
    while r:
        head = message(r.take(struct.unpack(">I", r.take(4))[0]))
        size = head[3][0]
        yield utf8(head[1][0]), r.at, size
        r.take(size)


def inflate(blob: bytes) -> bytes:
    m = message(blob)
    if 1 in m:
        return m[1][0]
    if 3 in m:
        return zlib.decompress(m[3][0])
    raise ValueError("blob compression not supported")


def frame(kind: str, payload: bytes, compress: bool = True) -> bytes:
    if len(payload) > MOST_PAYLOAD:
        raise OverflowError("payload too large")
    blob = put(2, len(payload)) + put(3, zlib.compress(payload)) if compress else put(1, payload)
    head = put(1, kind) + put(3, len(blob))
    if len(head) > MOST_HEADER:
        raise OverflowError("header too large")
    return struct.pack(">I", len(head)) + head + blob


def decode_header(payload: bytes) -> tuple[dict, tuple | None]:
    m = message(payload)
    box = None
    if 1 in m:
        b = message(m[1][0])
        left, right, top, bottom = ((v := b[k][0]) >> 1 ^ -(v & 1) for k in (1, 2, 3, 4))
        box = tuple(x * 1e-9 for x in (left, bottom, right, top))
    return {"is_diff": False, "file_type": "pbf", "writing_program": utf8(m[16][0]) if 16 in m else "", "required_features": [utf8(x) for x in m.get(4, [])]}, box


def encode_header(bounds: tuple | None = None, program: str = "terraframe", historical: bool = False) -> bytes:
    out = b""
    if bounds:
        lon0, lat0, lon1, lat1 = (round(x * 1e9) for x in bounds)
        out += put(1, b"".join(varint(k << 3) + zigzag(v) for k, v in ((1, lon0), (2, lon1), (3, lat1), (4, lat0))))
    for f in ["OsmSchema-V0.6", "DenseNodes", *["HistoricalInformation"] * historical]:
        out += put(4, f)
    return out + put(16, program)


def _cumulate(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def decode_block(payload: bytes, longitude_quirk: bool = False) -> Iterator[dict]:
    """Rows of one block. longitude_quirk: adds the date granularity to longitudes, in nanodegrees, as one known decoder does."""
    m = message(payload)
    if 1 not in m:
        raise ValueError("block without a string table")
    table = [utf8(x) for x in message(m[1][0]).get(1, [])]
    granularity, date = signed32(m.get(17, [100])[0]), signed32(m.get(18, [1000])[0])
    lat0, lon0 = signed64(m.get(19, [0])[0]), signed64(m.get(20, [0])[0])
    if longitude_quirk and 18 in m:
        lon0, date = date, 1000
    text = lambda i: table[i] if i else ""

    def when(units: int) -> int:
        v = units * date
        return v // 1000 if v >= 0 else -(-v // 1000)

    def meta(info: dict) -> dict:
        out = {}
        if 1 in info:
            out["version"] = signed32(info[1][0])
        if 2 in info:
            out["timestamp"] = when(signed64(info[2][0]))
        if 3 in info:
            out["changeset"] = signed64(info[3][0])
        if 4 in info:
            out["uid"] = signed32(info[4][0])
        if 5 in info:
            out["user"] = text(info[5][0])
        if 6 in info:
            out["visible"] = bool(info[6][0])
        return out

    def common(g: dict) -> tuple[dict, dict]:
        keys, values = unpacked(g.get(2, [])), unpacked(g.get(3, []))
        return {text(k): text(v) for k, v in zip(keys, values) if k}, meta(message(g[4][0])) if 4 in g else {}

    for raw in m.get(2, []):
        group = message(raw)
        for x in group.get(1, []):
            g = message(x)
            tags, info = common(g)
            at = lambda k: (g[k][0] >> 1) ^ -(g[k][0] & 1)
            yield blank("node", at(1), tags=tags, lat=1e-9 * (lat0 + granularity * at(8)), lon=1e-9 * (lon0 + granularity * at(9)), **info)
        for x in group.get(2, []):
            yield from _dense(message(x), table, granularity, lat0, lon0, when)
        for x in group.get(3, []):
            g = message(x)
            tags, info = common(g)
            yield blank("way", signed64(g[1][0]), tags=tags, refs=_cumulate(unpacked(g.get(8, []), "zigzag")), **info)
        for x in group.get(4, []):
            g = message(x)
            tags, info = common(g)
            roles, kinds = unpacked(g.get(8, [])), unpacked(g.get(10, []))
            refs = _cumulate(unpacked(g.get(9, []), "zigzag"))
            yield blank("relation", signed64(g[1][0]), tags=tags, members=[{"type": KINDS[k] if k < 3 else "", "ref": r, "role": text(s)} for k, r, s in zip(kinds, refs, roles)], **info)


def _dense(d: dict, table: list[str], granularity: int, lat0: int, lon0: int, when) -> Iterator[dict]:
    from ..operators.core import split_zero

    ids, lats, lons = (_cumulate(unpacked(d.get(k, []), "zigzag")) for k in (1, 8, 9))
    runs = split_zero(unpacked(d.get(10, []))) if 10 in d else [[]] * len(ids)
    info = message(d[5][0]) if 5 in d else {}
    columns: dict[str, list] = {}
    if 1 in info:
        columns["version"] = [signed32(v) for v in unpacked(info[1])]
    for k, name in ((2, "timestamp"), (3, "changeset"), (4, "uid"), (5, "user")):
        if k in info:
            columns[name] = _cumulate(unpacked(info[k], "zigzag"))
    if 6 in info:
        columns["visible"] = [bool(v) for v in unpacked(info[6])]
    if "timestamp" in columns:
        columns["timestamp"] = [*map(when, columns["timestamp"])]
    if "user" in columns:
        columns["user"] = [table[i] if i else "" for i in columns["user"]]
    for i, (id, lat, lon) in enumerate(zip(ids, lats, lons)):
        tags = {}
        for k, v in runs[i] if i < len(runs) else ():
            tags[table[k]] = table[v]
        yield blank("node", id, tags=tags, lat=1e-9 * (lat0 + granularity * lat), lon=1e-9 * (lon0 + granularity * lon), **{c: v[i] for c, v in columns.items() if i < len(v)})


def string_table(rows: list[dict], with_meta: bool) -> tuple[list[str], dict[str, int]]:
    """Strings by falling frequency, then bytes, behind the empty string at 0."""
    n: Counter[str] = Counter()
    for r in rows:
        for k, v in (r["tags"] or {}).items():
            n[k] += 1
            n[v] += 1
        if with_meta:
            n[r["user"]] += 1
        for x in r["members"] or ():
            n[x["role"]] += 1
    order = ["", *sorted(n, key=lambda s: (-n[s], s.encode()))]
    return order, {s: i for i, s in enumerate(order) if i}


def _small(v: int, name: str) -> int:
    if not -(2**31) <= v < 2**31:
        raise OverflowError(f"{name} {v} doesn't fit into 32 bits")
    return v


def encode_block(rows: list[dict], meta: bool = True, historical: bool = False, per_group: int = PER_GROUP, granularity: int = 100, date: int = 1000, lat0: int = 0, lon0: int = 0) -> bytes:
    """One block of rows of one type."""
    strings, at = string_table(rows, meta)
    time = lambda r: int(r["timestamp"] * 1000 / date) if date != 1000 else r["timestamp"]
    cell = lambda x, o: int((_away(x / 1e-9) - o) / granularity)
    groups = b""
    for k in range(0, len(rows), per_group):
        part = rows[k : k + per_group]
        kind = part[0]["type"]
        if kind == "node":
            deltas = lambda v: packed_deltas(v)
            tags = []
            for r in part:
                for a, b in sorted((r["tags"] or {}).items(), key=lambda e: e[0].encode()):
                    tags += [at[a], at[b]]
                tags.append(0)
            d = put(1, deltas([r["id"] for r in part]))
            if meta:
                info = packed(1, [_small(r["version"], "version") for r in part])
                for n, v in ((2, [time(r) for r in part]), (3, [r["changeset"] for r in part]), (4, [_small(r["uid"], "uid") for r in part]), (5, [at[r["user"]] if r["user"] else 0 for r in part])):
                    info += put(n, deltas(v))
                if historical:
                    info += packed(6, [int(r["visible"]) for r in part])
                d += put(5, info)
            d += put(8, deltas([cell(r["lat"], lat0) for r in part])) + put(9, deltas([cell(r["lon"], lon0) for r in part])) + packed(10, tags)
            groups += put(2, put(2, d))
            continue
        body = b""
        for r in part:
            x = put(1, r["id"])
            tags = sorted((r["tags"] or {}).items(), key=lambda e: e[0].encode())
            x += packed(2, [at[a] for a, _ in tags]) + packed(3, [at[b] for _, b in tags])
            if meta:
                info = put(1, _small(r["version"], "version")) + put(2, time(r)) + put(3, r["changeset"]) + put(4, _small(r["uid"], "uid")) + put(5, at[r["user"]] if r["user"] else 0)
                x += put(4, info + (put(6, int(r["visible"])) if historical else b""))
            if kind == "way":
                x += put(8, packed_deltas(r["refs"] or [])) if r["refs"] else b""
                body += put(3, x)
            else:
                own = [m for m in r["members"] or () if m["type"] in KINDS]
                if own:
                    x += packed(8, [at[m["role"]] if m["role"] else 0 for m in own]) + put(9, packed_deltas([m["ref"] for m in own])) + packed(10, [KINDS.index(m["type"]) for m in own])
                body += put(4, x)
        groups += put(2, body)
    out = put(1, b"".join(put(1, s) for s in strings)) + groups
    return out + put(17, granularity) + put(18, date) + put(19, lat0) + put(20, lon0)


def _away(v: float) -> float:
    import math

    return math.copysign(math.floor(abs(v) + 0.5), v)


def packed_deltas(values: Iterable[int]) -> bytes:
    out, last = bytearray(), 0
    for v in values:
        out += zigzag(v - last)
        last = v
    return bytes(out)


def encode_blobs(rows: list[dict], compress: bool = True, **options) -> Iterator[bytes]:
    """Data blobs of rows of one type; a block that is too large is halved."""
    if not rows:
        return
    try:
        yield frame("OSMData", encode_block(rows, **options), compress)
    except OverflowError:
        if len(rows) == 1:
            raise
        yield from encode_blobs(rows[: len(rows) // 2], compress, **options)
        yield from encode_blobs(rows[len(rows) // 2 :], compress, **options)


def decode(data: bytes, longitude_quirk: bool = False) -> Iterator[tuple[str, object]]:
    for kind, at, size in blobs(data):
        if kind == "OSMHeader":
            head, box = decode_header(inflate(data[at : at + size]))
            yield "header", head
            if box:
                yield "bounds", box
        elif kind == "OSMData":
            for row in decode_block(inflate(data[at : at + size]), longitude_quirk):
                yield "object", row

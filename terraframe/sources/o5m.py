"""The o5m and o5c binary formats: delta-coded records with a table of recent strings.

A file is a chain of segments, each beginning with a reset, after which nothing refers back. segments() finds them by stepping over
record lengths, so that a file can be read by segment.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

from ..schema import blank
from .wire import Cut, Reader, utf8, varint, zigzag

TABLE, LONGEST = 15_000, 250
KINDS = {0x10: "node", 0x11: "way", 0x12: "relation"}
CODES = {"node": 0, "way": 1, "relation": 2}
NAMES = {v: k for k, v in CODES.items()}


def e7(x: float) -> int:
    """Halves away from zero."""
    v = x * 1e7
    return int(math.floor(abs(v) + 0.5)) * (-1 if v < 0 else 1)


def check(data: bytes) -> None:
    if data[:2] != b"\xff\xe0":
        raise ValueError("not an o5m file")


def segments(data: bytes) -> list[tuple[int, int]]:
    """Places of runs of records between resets; an end record ends the last."""
    check(data)
    return list(runs(data, 1, len(data)))


def runs(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """As segments(), of a part that begins behind a reset."""
    begin = at
    while at < end:
        code = data[at]
        at += 1
        if code >= 0xF0:
            if begin < at - 1:
                yield begin, at - 1
            if code != 0xFF:
                return
            begin = at
            continue
        size = data[at] if at < end else 128
        at += 1
        if size > 127:
            r = Reader(data, at - 1, end)
            size, at = r.varint(), r.at
        at += size
        if at > end:
            raise Cut("input underflow")
    if begin < at:
        yield begin, at


class Decoder:
    def __init__(self, strict_roles: bool = False):
        self.strict = strict_roles
        self.table: list[bytes] = []
        self.count = 0
        self.id = self.time = self.changeset = self.lon = self.lat = 0
        self.refs = [0, 0, 0]

    def _entry(self, back: int) -> bytes:
        if not 0 < back <= len(self.table):
            raise ValueError(f"string reference {back} out of range, {len(self.table)} known")
        return self.table[(self.count - back) % TABLE]

    def _keep(self, text: bytes) -> None:
        if self.count < TABLE:
            self.table.append(text)
        else:
            self.table[self.count % TABLE] = text
        self.count += 1

    def _pair(self, r: Reader) -> tuple[bytes, bytes]:
        back = r.varint()
        if back:
            a, _, b = self._entry(back).partition(b"\0")
            return a, b
        a, b = r.text(), r.text()
        if len(a) + len(b) <= LONGEST:
            self._keep(a + b"\0" + b)
        return a, b

    def _meta(self, r: Reader) -> dict:
        out = {"version": r.varint()}
        if out["version"]:
            self.time += r.zigzag()
            out["timestamp"] = self.time
            if self.time:
                self.changeset += r.zigzag()
                uid, user = self._pair(r)
                out |= {"changeset": self.changeset, "uid": Reader(uid).varint() if uid else 0, "user": utf8(user)}
        return out

    def _tags(self, r: Reader) -> dict[str, str]:
        tags = {}
        while r:
            try:
                k, v = self._pair(r)
            except Cut:  # a last value cut short is passed over
                break
            tags[utf8(k)] = utf8(v)
        return tags

    def _member(self, r: Reader) -> dict:
        delta, back = r.zigzag(), r.varint()
        if back:
            text = self._entry(back)
        else:
            text = r.text()
            if len(text) <= LONGEST:
                self._keep(text)
        if not text or self.strict and len(text) < 2:
            raise ValueError("member type and role too short")
        code = text[0] - 48
        if code not in NAMES:
            return {"type": "", "ref": 0, "role": utf8(text[1:])}
        self.refs[code] += delta
        return {"type": NAMES[code], "ref": self.refs[code], "role": utf8(text[1:])}

    def records(self, data: bytes, begin: int, end: int) -> Iterator[tuple[str, object]]:
        """("header", is_diff, type), ("bounds", four degrees) and ("object", row) events of one segment."""
        r = Reader(data, begin, end)
        while r:
            code = r.take(1)[0]
            body = r.sub(r.varint())
            if code in KINDS:
                kind = KINDS[code]
                self.id += body.zigzag()
                row = blank(kind, self.id, **self._meta(body))
                if kind == "node":
                    self.lon += body.zigzag()
                    self.lat += body.zigzag()
                    row |= {"lon": self.lon / 1e7, "lat": self.lat / 1e7}
                else:
                    inner = body.sub(body.varint())
                    while inner:
                        try:
                            if kind == "way":
                                self.refs[0] += inner.zigzag()
                                row["refs"].append(self.refs[0])
                            else:
                                row["members"].append(self._member(inner))
                        except Cut:
                            break
                row["tags"] = self._tags(body)
                yield "object", row
            elif code == 0xDB:
                yield "bounds", tuple(body.zigzag() / 1e7 for _ in range(4))
            elif code == 0xE0:
                name = utf8(body.data[body.at : body.end])
                yield "header", {"is_diff": name == "o5c2", "file_type": name}


def decode(data: bytes, strict_roles: bool = False) -> Iterator[tuple[str, object]]:
    for begin, end in segments(data):
        yield from Decoder(strict_roles).records(data, begin, end)


class Encoder:
    """Segments of records; each begins with what a reset leaves."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.order: deque[bytes] = deque()
        self.count = 0
        self.id = self.time = self.changeset = self.lon = self.lat = 0
        self.refs = [0, 0, 0]

    def _string(self, text: bytes, size: int) -> bytes:
        """A reference to the text, or the text itself; it enters the table if it is short enough."""
        if text in self.known:
            return varint(self.count - self.known[text])
        if size <= LONGEST:
            if len(self.order) == TABLE:
                del self.known[self.order.popleft()]
            self.order.append(text)
            self.known[text] = self.count
            self.count += 1
        return b"\0" + text + b"\0"

    def _pair(self, a: bytes, b: bytes) -> bytes:
        return self._string(a + b"\0" + b, len(a) + len(b))

    def _meta(self, row: dict) -> bytes:
        if not row["version"]:
            return b"\0"
        out = varint(row["version"]) + zigzag(row["timestamp"] - self.time)
        self.time = row["timestamp"]
        if row["timestamp"]:
            out += zigzag(row["changeset"] - self.changeset)
            self.changeset = row["changeset"]
            out += self._pair(varint(row["uid"]) if row["uid"] else b"", row["user"].encode())
        return out

    def record(self, row: dict) -> bytes:
        kind = row["type"]
        out = zigzag(row["id"] - self.id) + self._meta(row)
        self.id = row["id"]
        if kind == "node":
            lon, lat = e7(row["lon"]), e7(row["lat"])
            out += zigzag(lon - self.lon) + zigzag(lat - self.lat)
            self.lon, self.lat = lon, lat
        else:
            inner = bytearray()
            for m in [("node", x, None) for x in row["refs"] or ()] if kind == "way" else [(m["type"], m["ref"], m["role"]) for m in row["members"] or ()]:
                if m[0] not in CODES:
                    raise ValueError(f"member type {m[0]!r}")
                c = CODES[m[0]]
                inner += zigzag(m[1] - self.refs[c])
                self.refs[c] = m[1]
                if m[2] is not None:
                    text = str(c).encode() + m[2].encode()
                    inner += self._string(text, len(text))
            out += varint(len(inner)) + inner
        for k, v in sorted((k.encode(), v.encode()) for k, v in (row["tags"] or {}).items()):
            out += self._pair(k, v)
        code = {"node": 0x10, "way": 0x11, "relation": 0x12}[kind]
        return bytes([code]) + varint(len(out)) + out


def header(is_diff: bool = False, bounds: Iterable[tuple] = ()) -> bytes:
    out = b"\xff\xe0" + varint(4) + (b"o5c2" if is_diff else b"o5m2")
    for b in bounds:
        body = b"".join(zigzag(e7(x)) for x in b)
        out += b"\xdb" + varint(len(body)) + body
    return out


def body(rows: Iterable[dict], reset_types: bool = True) -> Iterator[bytes]:
    """Records, with a reset before the first and where the type changes."""
    enc, last = Encoder(), None
    for row in rows:
        if last is None or reset_types and row["type"] != last:
            yield b"\xff"
            enc.reset()
        last = row["type"]
        yield enc.record(row)


FOOTER = b"\xfe"

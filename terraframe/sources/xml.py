"""Map XML and change XML: an incremental parser that takes chunks, places at which a file can be read by pieces, and writers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from xml.parsers import expat

import numpy as np

from ..operators.core import LIMITS, parse_limits
from ..schema import blank

KINDS = ("node", "way", "relation")
_INT = re.compile(r"\s*([+-]?[0-9]+)")
_FLOAT = re.compile(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")


def to_int(s: str | None) -> int:
    if s is None:
        return 0
    if len(s) < 19 and s.isascii() and s.isdigit():
        return int(s)
    m = _INT.match(s or "")
    v = int(m[1]) if m else 0
    return v if -(2**63) <= v < 2**63 else 0


def to_float(s: str | None) -> float:
    m = _FLOAT.match(s or "")
    return float(m[1]) if m else 0.0


def to_epoch(s: str | None) -> int:
    if not s:
        return 0
    try:
        t = datetime.fromisoformat((s or "").replace("Z", "+00:00"))
    except ValueError:
        return 0
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp())


def meta_of(a: dict[str, str]) -> dict:
    return {
        "version": to_int(a.get("version")), "timestamp": to_epoch(a.get("timestamp")), "changeset": to_int(a.get("changeset")), "uid": to_int(a.get("uid")),
        "user": a.get("user", ""), "visible": a.get("visible") != "false", "current": a.get("current") != "false",
    }


class LimitError(ValueError):
    pass


class Parser:
    """Feed chunks, take events: ("bounds", four degrees), ("object", row) and, of change files, ("open", action, if_unused) and
    ("close",). Elements are told by depth: objects stand one level below the root, in change files two."""

    def __init__(self, change: bool = False, limits: dict | None = None):
        self.top = 3 if change else 2
        self.limits = parse_limits(limits or {})
        self.limited = any(self.limits.values())
        self.root = ""
        self.events: list[tuple] = []
        self.depth = self.bytes = self.objects = 0
        self.row: dict | None = None
        self.tags = 0
        self.p = expat.ParserCreate()
        self.p.StartElementHandler, self.p.EndElementHandler = self._start, self._end
        self.p.buffer_text = True

    def _limit(self, name: str, actual: int) -> None:
        if self.limits[name] and actual > self.limits[name]:
            raise LimitError(f"{LIMITS[name]} limit exceeded; maximum is {self.limits[name]}, got {actual}")

    def feed(self, chunk: bytes, done: bool = False) -> list[tuple]:
        self.bytes += len(chunk)
        self._limit("max_bytes", self.bytes)
        self.p.Parse(chunk, done)
        out, self.events = self.events, []
        return out

    def _start(self, name: str, a: dict[str, str]) -> None:
        self.depth += 1
        limited = self.limited
        if limited:
            self._limit("max_depth", self.depth)
            self._limit("max_attributes_per_element", len(a))
            self._limit("max_attribute_bytes", len(name.encode()) + sum(len(k.encode()) + len(v.encode()) for k, v in a.items()))
        below = self.depth - self.top
        if below == 1:
            row = self.row
            if row is None:
                return
            if name == "nd" and row["type"] == "way":
                if limited:
                    self._limit("max_way_nodes_per_object", len(row["refs"]) + 1)
                row["refs"].append(to_int(a.get("ref")))
            elif name == "tag":
                if limited:
                    self.tags += 1
                    self._limit("max_tags_per_object", self.tags)
                row["tags"][a.get("k", "")] = a.get("v", "")
            elif name == "member" and row["type"] == "relation":
                if limited:
                    self._limit("max_relation_members_per_object", len(row["members"]) + 1)
                row["members"].append({"type": a.get("type", ""), "ref": to_int(a.get("ref")), "role": a.get("role", "")})
        elif below == 0:
            self.row, self.tags = None, 0
            if name in KINDS:
                self.objects += 1
                if limited:
                    self._limit("max_objects", self.objects)
                self.row = blank(name, to_int(a.get("id")), **meta_of(a))
                if name == "node":
                    self.row["lat"], self.row["lon"] = to_float(a.get("lat")), to_float(a.get("lon"))
            elif name == "bounds":
                self.events.append(("bounds", tuple(to_float(a.get(k)) for k in ("minlon", "minlat", "maxlon", "maxlat"))))
        elif self.depth == 2 and self.top == 3:
            self.events.append(("open", name, "if-unused" in a))
        elif self.depth == 1:
            self.root = name

    def _end(self, name: str) -> None:
        if self.depth == self.top and self.row is not None:
            self.events.append(("object", self.row))
            self.row = None
        elif self.top == 3 and self.depth == 2:
            self.events.append(("close",))
        self.depth -= 1


def decode(chunks: Iterable[bytes], change: bool = False, limits: dict | None = None, permissive: bool = False) -> Iterator[tuple]:
    """permissive: what precedes an error is kept, the error passed over."""
    p = Parser(change, limits)
    try:
        for c in chunks:
            yield from p.feed(c)
        yield from p.feed(b"", True)
    except (expat.ExpatError, LimitError):
        if not permissive:
            raise
        yield from p.events


def decode_piece(prolog: bytes, chunks: Iterable[bytes], last: bool, change: bool = False) -> Iterator[tuple]:
    """Events of one of pieces(): chunks hold whole children of the root, the last ones of a file its end as well. prolog: the file up to
    the end of the root's tag."""
    p = Parser(change)
    p.feed(prolog)
    for c in chunks:
        yield from p.feed(c)
    yield from p.feed(b"" if last else f"</{p.root}>".encode(), True)


PIECE, MOST_PIECES, SCAN = 4 << 20, 512, 8 << 20
_TAG = re.compile(rb"""<[^"'<>]*(?:"[^"<]*"[^"'<>]*|'[^'<]*'[^"'<>]*)*>""")
_ENCODING = re.compile(rb"""<\?xml[^>]*?encoding\s*=\s*["']([^"']*)""")


def pieces(data) -> list[tuple[int, int, int, int]]:
    """(begin, end, end of the root's tag, children of the root before begin) of runs of whole children of the root, told by counting
    tags. None are told, so the file must be read as one, of small files, of encodings that don't contain ASCII, where comments, CDATA,
    a document type or further instructions make "<" ambiguous, and where tags don't match in number."""
    size = len(data)
    found = _ENCODING.match(data[:200])
    if size <= PIECE or data[:1] != b"<" or b"\0" in data[:4] or found and found[1].lower() not in (b"utf-8", b"us-ascii"):
        return []
    least = max(PIECE, -(-size // MOST_PIECES))
    out, root, depth, children, begin, before, at = [], 0, 0, 0, 0, 0, 0
    while at < size:
        chunk = data[at : at + SCAN]
        if at + len(chunk) < size:  # up to the last "<", whose tag may be cut
            cut = chunk.rfind(b"<")
            if cut <= 0:
                return []
            chunk = chunk[:cut]
        a = np.frombuffer(chunk, np.uint8)
        opens, shuts = np.flatnonzero(a == 60), np.flatnonzero(a == 62)
        if opens[-1] + 1 >= len(a):
            return []
        next_byte = a[opens + 1]
        odd = np.flatnonzero((next_byte == 33) | (next_byte == 63))
        if len(odd) and not (at == 0 and odd.tolist() == [0] and next_byte[0] == 63):
            return []
        first = np.searchsorted(shuts, opens)
        if first[-1] >= len(shuts):
            return []
        ends = shuts[np.minimum(first, len(shuts) - 1)]
        for i in np.flatnonzero(np.diff(first, append=len(shuts)) != 1).tolist():  # ">" in a value or in text
            m = _TAG.match(chunk, int(opens[i]))
            if not m:
                return []
            ends[i] = m.end() - 1
        if at == 0 and len(odd):
            opens, ends, next_byte = opens[1:], ends[1:], next_byte[1:]
        starts = next_byte != 47
        step = np.where(starts, (a[ends - 1] != 47).astype(np.int64), -1)
        levels = depth + np.cumsum(step) - step
        if not root:
            if not len(opens) or step[0] != 1:
                return []
            begin = root = int(ends[0]) + 1
        child = np.flatnonzero(starts & (levels == 1))
        places = at + opens[child]
        i = int(np.searchsorted(places, begin + least))
        while i < len(places):
            out.append((begin, int(places[i]), root, before))
            begin, before = int(places[i]), children + i
            i = int(np.searchsorted(places, begin + least))
        children += len(child)
        depth += int(step.sum())
        at += len(chunk)
    out.append((begin, size, root, before))
    return out if depth == 0 else []


_ESCAPES = str.maketrans({"&": "&amp;", "'": "&apos;", '"': "&quot;", "<": "&lt;", ">": "&gt;", "\n": "&#10;"})


def escape(s: str) -> str:
    return s.translate(_ESCAPES)


def element(row: dict) -> str:
    kind = row["type"]
    a = [("id", row["id"])]
    if row["timestamp"]:
        a.append(("timestamp", datetime.fromtimestamp(row["timestamp"], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")))
    a += [("uid", row["uid"])] if row["uid"] else []
    a += [("user", escape(row["user"]))] if row["user"] else []
    a.append(("visible", "true" if row["visible"] else "false"))
    a += [(c, row[c]) for c in ("version", "changeset") if row[c]]
    if kind == "node":
        a += [(c, f"{row[c]:.9f}") for c in ("lat", "lon")]
    inner = [f'    <nd ref="{x}" />\n' for x in row["refs"] or ()]
    inner += [f'    <member type="{escape(m["type"])}" ref="{m["ref"]}" role="{escape(m["role"])}" />\n' for m in row["members"] or ()]
    inner += [f'    <tag k="{escape(k)}" v="{escape(v)}" />\n' for k, v in sorted((row["tags"] or {}).items(), key=lambda e: e[0].encode())]
    head = f"  <{kind} " + " ".join(f'{k}="{v}"' for k, v in a)
    return head + (" />\n" if not inner else ">\n" + "".join(inner) + f"  </{kind}>\n")


def prolog(attributes: dict[str, str] | None = None, bounds: Iterable[tuple] = ()) -> str:
    own = {"version": "0.6", "generator": "terraframe"} | {k: v for k, v in sorted((attributes or {}).items())}
    text = " ".join(f'{escape(k)}="{escape(v)}"' for k, v in own.items() if v or k in ("version", "generator"))
    out = f"<?xml version='1.0' encoding='UTF-8'?>\n<osm {text}>\n"
    for lon0, lat0, lon1, lat1 in bounds:
        out += f'  <bounds minlat="{lat0:.9f}" minlon="{lon0:.9f}" maxlat="{lat1:.9f}" maxlon="{lon1:.9f}" />\n'
    return out


EPILOG = "</osm>"


def change_document(blocks: Iterable[tuple[str, bool, list[dict]]], separate: bool = False, write_if_unused: bool = False) -> Iterator[str]:
    """blocks: action, if_unused, rows in order. separate: an action element for each object."""
    yield '<osmChange version="0.6" generator="terraframe">\n'
    yield from change_blocks(blocks, separate, write_if_unused)
    yield "</osmChange>\n"


def change_blocks(blocks: Iterable[tuple[str, bool, list[dict]]], separate: bool = False, write_if_unused: bool = False) -> Iterator[str]:
    for action, unused, rows in blocks:
        opened = f"<{action}{' if-unused="true"' if unused and write_if_unused else ''}>\n"
        order = [r for k in (KINDS[::-1] if action == "delete" else KINDS) for r in rows if r["type"] == k]
        for part in [[r] for r in order] if separate else [order]:
            yield opened + "".join(map(element, part)) + f"</{action}>\n"

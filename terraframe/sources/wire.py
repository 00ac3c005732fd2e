"""Bytes: varints, zigzag and length-delimited fields, shared by the binary codecs."""

from __future__ import annotations

from collections.abc import Iterator


class Cut(ValueError):
    """The input ends within a value."""


def _varint(v: int) -> bytes:
    v &= 2**64 - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


_SMALL = [_varint(v) for v in range(1 << 14)]


def varint(v: int) -> bytes:
    return _SMALL[v] if 0 <= v < 1 << 14 else _varint(v)


def zigzag(v: int) -> bytes:
    u = v << 1 if v >= 0 else ~(v << 1)
    return _SMALL[u] if u < 1 << 14 else _varint(u)


def take_varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    """A value and the place behind it."""
    out = shift = 0
    while at < end:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out & (2**64 - 1), at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")
    raise Cut("input underflow")


def varints(data: bytes) -> list[int]:
    out = []
    v = shift = 0
    for b in data:
        if b < 128:
            out.append((v | b << shift) & (2**64 - 1) if shift else b)
            v = shift = 0
        else:
            v |= (b & 127) << shift
            shift += 7
            if shift > 63:
                raise ValueError("varint too long")
    if shift:
        raise Cut("input underflow")
    return out


class Reader:
    """A place in a buffer."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def __bool__(self) -> bool:
        return self.at < self.end

    def varint(self) -> int:
        at = self.at
        if at < self.end and (b := self.data[at]) < 128:
            self.at = at + 1
            return b
        out, self.at = take_varint(self.data, at, self.end)
        return out

    def signed(self) -> int:
        v = self.varint()
        return v - 2**64 if v >= 2**63 else v

    def zigzag(self) -> int:
        at = self.at
        if at < self.end and (v := self.data[at]) < 128:
            self.at = at + 1
        else:
            v, self.at = take_varint(self.data, at, self.end)
        return v >> 1 ^ -(v & 1)

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise Cut("input underflow")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> bytes:
        """Up to a zero byte, which is passed over."""
        stop = self.data.find(b"\0", self.at, self.end)
        if stop < 0:
            raise Cut("end of input in a string")
        out, self.at = self.data[self.at : stop], stop + 1
        return out

    def sub(self, n: int) -> Reader:
        if self.at + n > self.end:
            raise Cut("input underflow")
        self.at += n
        return Reader(self.data, self.at - n, self.at)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; length-delimited values as bytes."""
    at, end = 0, len(data)
    while at < end:
        tag = data[at]
        at += 1
        if tag > 127:
            tag, at = take_varint(data, at - 1, end)
        kind = tag & 7
        if kind == 0 or kind == 2:
            v = data[at] if at < end else 128
            at += 1
            if v > 127:
                v, at = take_varint(data, at - 1, end)
            if kind == 2:
                begin, at = at, at + v
                if at > end:
                    raise Cut("input underflow")
                v = data[begin:at]
        elif kind == 1 or kind == 5:
            begin, at = at, at + (8 if kind == 1 else 4)
            if at > end:
                raise Cut("input underflow")
            v = int.from_bytes(data[begin:at], "little")
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, v


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for k, v in fields(data):
        if k in out:
            out[k].append(v)
        else:
            out[k] = [v]
    return out


def put(number: int, value: int | bytes | str) -> bytes:
    """One field: integers as varints, everything else length-delimited."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode("utf-8", "surrogateescape") if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def packed(number: int, values: list[int], code=varint) -> bytes:
    return put(number, b"".join(map(code, values))) if values else b""


def unpacked(chunks: list, how: str = "varint") -> list[int]:
    """A repeated number, packed or not."""
    out = []
    for c in chunks:
        out += [c] if isinstance(c, int) else varints(c)
    return [v >> 1 ^ -(v & 1) for v in out] if how == "zigzag" else out


def signed32(v: int) -> int:
    v &= 2**32 - 1
    return v - 2**32 if v >= 2**31 else v


def signed64(v: int) -> int:
    return v - 2**64 if v >= 2**63 else v


def utf8(raw: bytes) -> str:
    """Text of bytes; bytes that aren't UTF-8 become the replacement character."""
    return raw.decode("utf-8", "replace")

"""Scalar functions of the map formats as Column expressions; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zigzag(v: Column | str) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3 (as the bits of a long)."""
    v = _c(v).cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column | str) -> Column:
    z = _c(z).cast("long")
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def varint_len(v: Column | str) -> Column:
    """Bytes of an unsigned varint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(_c(v).cast("long"))) / F.lit(7.0))).cast("int")


def varint_hex(v: Column | str) -> Column:
    """The varint of an unsigned value, as hexadecimal digits: seven bits a byte, lowest first, the high bit on all but the last."""
    v = _c(v).cast("long")
    n = varint_len(v)
    parts = []
    for i in range(10):
        seven = F.shiftrightunsigned(v, 7 * i).bitwiseAND(F.lit(127).cast("long"))
        byte = F.lpad(F.hex(seven + F.when(n > i + 1, 128).otherwise(0)), 2, "0")
        parts.append(F.when(n > i, byte).otherwise(""))
    return F.lower(F.concat(*parts))


def varint(v: Column | str) -> Column:
    return F.unhex(varint_hex(v))


def unvarint(data: Column | str) -> Column:
    """The value of a binary column that holds one varint; null where it is cut short or longer than ten bytes."""
    digits = F.hex(_c(data))
    n = F.length(digits) / 2
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("long")
    bits = [F.coalesce(F.when(n > i, F.shiftleft(byte(i).bitwiseAND(F.lit(127).cast("long")), 7 * i)), F.lit(0).cast("long")) for i in range(10)]
    last = F.conv(F.substring(digits, -2, 2), 16, 10).cast("int")
    return F.when((n >= 1) & (n <= 10) & (last < 128), reduce(lambda a, b: a.bitwiseOR(b), bits))


def xml_escape(s: Column | str) -> Column:
    out = _c(s)
    for a, b in (("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def lenient_long(s: Column | str) -> Column:
    """The integer a text begins with, 0 if none."""
    return F.coalesce(F.regexp_extract(_c(s), r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("long"))


def lenient_double(s: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(_c(s), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def lenient_bool(s: Column | str) -> Column:
    return F.coalesce(_c(s) != "false", F.lit(True))


def iso_to_epoch(s: Column | str) -> Column:
    """Epoch seconds of an ISO 8601 time, offsets applied, 0 where there is none to read; the session's time zone must be UTC."""
    return F.coalesce(F.unix_seconds(_c(s).try_cast("timestamp")), F.lit(0).cast("long"))


def epoch_to_iso(t: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_c(t)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fixed_e7(x: Column | str) -> Column:
    """Degrees in units of 1e-7, halves away from zero."""
    return F.round(_c(x) * F.lit(1e7)).cast("long")


def from_e7(v: Column | str) -> Column:
    return _c(v) / F.lit(1e7)


def grid(x: Column | str, granularity: int = 100, offset: int = 0) -> Column:
    """Degrees on the block grid: nanodegrees rounded, less offset, divided by the granularity and truncated."""
    return ((F.round(_c(x) / F.lit(1e-9)) - F.lit(float(offset))) / F.lit(float(granularity))).cast("long")


def from_grid(v: Column | str, granularity: int = 100, offset: int = 0) -> Column:
    return F.lit(1e-9) * (F.lit(offset) + F.lit(granularity) * _c(v))


def to_date_units(t: Column | str, granularity: int = 1000) -> Column:
    return ((_c(t) * 1000) / F.lit(granularity)).cast("long")


def from_date_units(t: Column | str, granularity: int = 1000) -> Column:
    return ((_c(t) * granularity) / F.lit(1000)).cast("long")


def member_code(kind: Column | str) -> Column:
    """0, 1, 2 for node, way, relation; null for others."""
    return F.when(_c(kind) == "node", 0).when(_c(kind) == "way", 1).when(_c(kind) == "relation", 2)


def member_type(code: Column | str) -> Column:
    return F.when(_c(code) == 0, "node").when(_c(code) == 1, "way").when(_c(code) == 2, "relation").otherwise("")


def limit_message(name: str, limit: int, actual: Column | str) -> Column:
    return F.concat(F.lit(f"{name} limit exceeded; maximum is {limit}, got "), _c(actual).cast("string"))


def split_plain(s: Column | str, delimiter: str) -> Column:
    """Parts between delimiters, without one trailing empty part; of an empty text, none."""
    parts = F.split(_c(s), f"\\Q{delimiter}\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

"""Types of map data: objects, bounds, header, change blocks. Every table carries seq, the place in its input: operators whose result
depends on order use that, never the order of rows."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = ("node", "way", "relation")
MEMBER = T.StructType([T.StructField("type", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("role", T.StringType())])
META = [("version", T.LongType()), ("timestamp", T.LongType()), ("changeset", T.LongType()), ("uid", T.LongType()), ("user", T.StringType()), ("visible", T.BooleanType()), ("current", T.BooleanType())]
_OBJECT = [("type", T.StringType()), ("id", T.LongType()), *META, ("tags", T.MapType(T.StringType(), T.StringType())), ("lat", T.DoubleType()), ("lon", T.DoubleType()), ("refs", T.ArrayType(T.LongType())), ("members", T.ArrayType(MEMBER))]
BOUNDS_FIELDS = [(c, T.DoubleType()) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


OBJECT = _struct([("seq", T.LongType()), *_OBJECT])
BOUNDS = _struct([("seq", T.LongType()), *BOUNDS_FIELDS])
HEADER = _struct([("is_diff", T.BooleanType()), ("file_type", T.StringType()), ("writing_program", T.StringType()), ("required_features", T.ArrayType(T.StringType()))])
CHANGE = _struct([("block_no", T.IntegerType()), ("action", T.StringType()), ("if_unused", T.BooleanType()), ("is_diff", T.BooleanType()), ("pos", T.LongType()), *_OBJECT])

#: What absent metadata stands for: the model has no nulls there.
DEFAULTS = {"version": 0, "timestamp": 0, "changeset": 0, "uid": 0, "user": "", "visible": True, "current": True}


def blank(kind: str, id: int, **more) -> dict:
    """A row of OBJECT without seq, all defaults."""
    return {"type": kind, "id": id, **DEFAULTS, "tags": {}, "lat": 0.0 if kind == "node" else None, "lon": 0.0 if kind == "node" else None, "refs": [] if kind == "way" else None, "members": [] if kind == "relation" else None} | more

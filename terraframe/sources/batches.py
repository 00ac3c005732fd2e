"""Rows as the codecs take and give them (dicts, schema.blank) from and to Arrow batches, a column at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import DEFAULTS

ROWS = 8192


def of_rows(rows: Iterator[dict], schema: StructType) -> Iterator[pa.RecordBatch]:
    s = to_arrow_schema(schema)
    while own := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([_array([r.get(f.name) for r in own], f.type) for f in s], schema=s)


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_map(kind):
        own = [v for v in values if v]
        keys, items = pa.array([k for v in own for k in v], kind.key_type), pa.array([x for v in own for x in v.values()], kind.item_type)
        return pa.MapArray.from_arrays(_ends(values), keys, items).cast(kind)
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):  # members
        flat = [m for v in values if v for m in v]
        parts = [pa.array([m[f.name] for m in flat], f.type) for f in kind.value_type]
        return pa.ListArray.from_arrays(_ends(values), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(_ends(values), pa.array([x for v in values if v for x in v], kind.value_type), type=kind)
    return pa.array(values, kind)


def _ends(values: list) -> pa.Array:
    """Where each list begins; null for a missing one."""
    out, at = [], 0
    for v in values:
        out.append(None if v is None else at)
        at += len(v) if v else 0
    return pa.array([*out, at], pa.int32())


def to_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with all fields: what a column lacks is as in schema.blank, and so is metadata that is null."""
    for b in batches:
        columns = {name: _values(b.column(i)) for i, name in enumerate(b.schema.names)}
        for name, v in DEFAULTS.items():
            own = columns.get(name)
            columns[name] = [v] * b.num_rows if own is None else [v if x is None else x for x in own] if b.column(name).null_count else own
        kinds = columns["type"]
        for name, kind, new in (("tags", None, dict), ("lat", "node", float), ("lon", "node", float), ("refs", "way", list), ("members", "relation", list)):
            if name not in columns:
                columns[name] = [new() if kind in (None, k) else None for k in kinds]
        names = list(columns)
        for row in zip(*columns.values()):
            yield dict(zip(names, row))


def _values(a: pa.Array) -> list:
    t = a.type
    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_map(t):
        keys, items = _values(a.keys), _values(a.items)
        return _runs(a, lambda i, j: dict(zip(keys[i:j], items[i:j])))
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        if pa.types.is_struct(t.value_type):  # members
            if a.values.null_count:
                raise ValueError("a member is null")
            kinds, refs, roles = (_values(a.values.field(i)) for i in range(3))
            flat = [{"type": k, "ref": r, "role": x} for k, r, x in zip(kinds, refs, roles)]
        else:
            flat = _values(a.values)
        return _runs(a, lambda i, j: flat[i:j])
    if a.null_count or pa.types.is_boolean(t) or not (pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_string(t) or pa.types.is_large_string(t)):
        return a.to_pylist()
    return a.to_numpy(zero_copy_only=False).tolist()


def _runs(a: pa.Array, run) -> list:
    ends = a.offsets.to_numpy().tolist()
    if not a.null_count:
        return [run(i, j) for i, j in zip(ends, ends[1:])]
    return [run(i, j) if v else None for v, i, j in zip(a.is_valid().to_pylist(), ends, ends[1:])]

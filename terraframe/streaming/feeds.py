"""Structured streaming: arriving map files, first-wins dedup, change classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.core import action
from ..schema import CHANGE, OBJECT
from ..sources import o5m, pbf, xml
from ..sources.formats import _plain, change_rows, register


def _decode(name: str, data: bytes) -> list[dict]:
    """Objects by the suffix of a file's name; those of a change file with the columns of its blocks."""
    if name.endswith(".osc"):
        return [r | {"seq": i} for i, r in enumerate((r for kind, r in change_rows(xml.decode([data], True)) if kind == "object"), 1)]
    for suffix, events in {".o5m": lambda: o5m.decode(data), ".pbf": lambda: pbf.decode(data), ".osm": lambda: xml.decode([data])}.items():
        if name.endswith(suffix):
            return [v[0] | {"seq": i} for i, (k, *v) in enumerate(events(), 1) if k == "object"]
    raise ValueError(f"no format is known for {name!r}")


def read_arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Objects of files (.o5m, .osm, .pbf, .osc) as they arrive in a folder, with arrived, the file's time, and block_no, action,
    if_unused, is_diff and pos, which are null but for objects of change files. A file with another suffix is an error."""
    register(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    schema = T.StructType([T.StructField("arrived", T.TimestampType()), *OBJECT.fields, *CHANGE.fields[:5]])

    def rows(it):
        import pandas as pd

        for pdf in it:
            for path, when, data in zip(pdf["path"], pdf["modificationTime"], pdf["content"]):
                objects = _decode(path, bytes(data))
                if objects:
                    yield pd.DataFrame([(when, *[_value(f, o.get(f)) for f in schema.names[1:]]) for o in objects], columns=schema.names, dtype=object)

    return files.select("path", "modificationTime", "content").mapInPandas(rows, schema)


def _value(field: str, v):
    return [dict(zip(("type", "ref", "role"), m)) for m in _plain(field, v)] if field == "members" and v is not None else v


def dedup_stream(objects: DataFrame, watermark: str | None = None, time: str = "arrived") -> DataFrame:
    """The first object of each (type, id). Without a watermark the state holds every key seen; with one, keys expire."""
    if watermark is None:
        return objects.dropDuplicates(["type", "id"])
    return objects.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["type", "id"])


def change_counts(edits: DataFrame, time: str, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Edits by action in tumbling windows: the action that a change file states, or else the one that version and visible tell."""
    told = F.coalesce("action", action()) if "action" in edits.columns else action()
    return edits.withWatermark(time, watermark).groupBy(F.window(time, window), told.alias("action")).agg(F.count("*").alias("n"))

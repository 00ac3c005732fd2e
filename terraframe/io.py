"""Reading, writing and converting map files; `python -m terraframe.io IN -o OUT [--sort]`."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .operators.core import enforce_limits, output_rank, type_rank
from .schema import CHANGE, OBJECT
from .sources import o5m, pbf, xml
from .sources.formats import _plain, change_rows, register

FORMATS = {".o5m": "o5m", ".osm": "osm_xml", ".pbf": "osm_pbf"}


def format_of(path: str) -> str:
    """By the last four characters of a name."""
    if path[-4:] not in FORMATS:
        raise ValueError(f"no format is known for {path!r}")
    return FORMATS[path[-4:]]


def read_osm(spark: SparkSession, path: str, table: str = "objects", fmt: str | None = None, **options) -> DataFrame:
    register(spark)
    return spark.read.format(fmt or format_of(path)).options(table=table, **options).load(path)


def read_change(spark: SparkSession, path: str, table: str = "objects", **options) -> DataFrame:
    register(spark)
    return spark.read.format("osm_change").options(table=table, **options).load(path)


def from_bytes(spark: SparkSession, data: bytes, fmt: str, limits: dict | None = None) -> DataFrame:
    """Objects of a document in memory; of a change document (osm_change), with the columns of its blocks."""
    if fmt == "osm_change":
        rows = [r for kind, r in change_rows(xml.decode([data], True, limits)) if kind == "object"]
        return spark.createDataFrame([tuple(_plain(f, r.get(f)) for f in CHANGE.names) for r in rows], CHANGE)
    events = {"o5m": lambda: o5m.decode(data), "osm_pbf": lambda: pbf.decode(data), "osm_xml": lambda: xml.decode([data], limits=limits)}[fmt]()
    rows = [v[0] | {"seq": i} for i, (k, *v) in enumerate(events, 1) if k == "object"]
    return spark.createDataFrame([tuple(_plain(f, r.get(f)) for f in OBJECT.names) for r in rows], OBJECT)


def write_osm(objects: DataFrame, path: str, bounds: Iterable[tuple] = (), fmt: str | None = None, by_id: bool = False, limits: dict | None = None, **options) -> None:
    """One file, in the order of seq, or by type and id. bounds: (min_lon, min_lat, max_lon, max_lat) each."""
    register(objects.sparkSession)
    d = enforce_limits(objects, limits) if limits else objects
    d = d.orderBy(type_rank(), "id", "seq") if by_id else d.orderBy("seq")
    d.write.format(fmt or format_of(path)).options(bounds=json.dumps([list(b) for b in bounds]), **{k: str(v) for k, v in options.items()}).mode("overwrite").save(path)


def write_change(changes: DataFrame, path: str, separate_actions: bool = False, write_if_unused: bool = False) -> None:
    register(changes.sparkSession)
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = changes.repartitionByRange(parts, "block_no").sortWithinPartitions("block_no", output_rank(), "pos")
    d.write.format("osm_change").options(separate_actions=str(separate_actions), write_if_unused=str(write_if_unused)).mode("overwrite").save(path)


def write_stream(objects: DataFrame, out, fmt: str, bounds: Iterable[tuple] = ()) -> None:
    """To anything with write(bytes), partition by partition."""
    rows = ({**r.asDict(recursive=True)} for r in objects.orderBy("seq").toLocalIterator())
    if fmt == "o5m":
        out.write(o5m.header(bounds=bounds))
        for b in o5m.body(rows):
            out.write(b)
        out.write(o5m.FOOTER)
    elif fmt == "osm_xml":
        out.write(xml.prolog(bounds=bounds).encode())
        for r in rows:
            out.write(xml.element(r).encode())
        out.write(xml.EPILOG.encode())
    elif fmt == "osm_pbf":
        from .operators.core import PER_BLOCK

        own: list[dict] = []
        out.write(pbf.frame("OSMHeader", pbf.encode_header(next(iter(bounds), None))))
        for r in rows:
            if own and (r["type"] != own[0]["type"] or len(own) >= PER_BLOCK[r["type"]]):
                for b in pbf.encode_blobs(own):
                    out.write(b)
                own = []
            own.append(r)
        for b in pbf.encode_blobs(own):
            out.write(b)
    else:
        raise ValueError(f"no format {fmt!r}")


def convert(spark: SparkSession, source: str, target: str, sort: bool = False, source_format: str | None = None, target_format: str | None = None) -> None:
    """All objects and all bounds, in order; a PBF header has room for the first bounds only."""
    objects = read_osm(spark, source, fmt=source_format)
    found = read_osm(spark, source, "bounds", source_format).orderBy("seq").collect()
    if target_format == "null":
        objects.write.format("noop").mode("overwrite").save()
    else:
        write_osm(objects, target, [tuple(r)[1:] for r in found], target_format, by_id=sort)


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="terraframe", description="Convert map files")
    p.add_argument("input", nargs="+", help="a file, or - for standard input; only the first is read")
    p.add_argument("-o", "--output", help="a file; standard output if left out")
    p.add_argument("--sort", action="store_true", help="by type and id")
    for side in ("in", "out"):
        for name in ("o5m", "osm", "pbf", *["null"] * (side == "out")):
            p.add_argument(f"--{side}-{name}", action="store_true")
    a = vars(p.parse_args(arguments))
    names = {"o5m": "o5m", "osm": "osm_xml", "pbf": "osm_pbf", "null": "null"}

    def chosen(side: str, path: str | None, order: tuple[str, ...], default: str | None) -> str:
        for n in order:
            if a[f"{side}_{n}"] or path and n != "null" and path.endswith(f".{n}"):
                return names[n]
        if default is None:
            raise SystemExit(f"no format is known for {path}")
        return default

    source, target = a["input"][0], a["output"]
    fmt_in = chosen("in", source, ("o5m", "osm", "pbf"), "osm_xml" if source == "-" else None)
    fmt_out = chosen("out", target, ("null", "o5m", "pbf", "osm"), None if target else "osm_xml")
    spark = SparkSession.builder.appName("terraframe").getOrCreate()
    with tempfile.TemporaryDirectory() as spool:
        if source == "-":
            source = f"{spool}/in"
            with open(source, "wb") as f:
                shutil.copyfileobj(sys.stdin.buffer, f)
        if target or fmt_out == "null":
            convert(spark, source, target or "", a["sort"], fmt_in, fmt_out)
        else:
            convert(spark, source, f"{spool}/out", a["sort"], fmt_in, fmt_out)
            with open(f"{spool}/out", "rb") as f:
                shutil.copyfileobj(f, sys.stdout.buffer)
    return 0


if __name__ == "__main__":
    sys.exit(main())

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from terraframe import io as tio
from terraframe.functions import scalars as X
from terraframe.operators import core as C
from terraframe.plans import queries as Q
from terraframe.schema import OBJECT, blank

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_sql(spark, name):
    import os

    got = Q.queries()[name](spark, SF)
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    want = c.execute(Q.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(names).collect()), key=key) == sorted(want.fetchall(), key=key)


def objects(spark, rows):
    return spark.createDataFrame([tuple((r | {"seq": i})[f] if f != "members" or r[f] is None else [(m["type"], m["ref"], m["role"]) for m in r[f]] for f in OBJECT.names) for i, r in enumerate(rows)], OBJECT)


ROWS = [blank("node", 3, lat=1.5, lon=2.5, tags={"b": "2", "a": "1"}), blank("way", 2, refs=[3, 3, 1]), blank("node", 1, lat=-1.0, lon=0.0), blank("node", 3, lat=9.0), blank("relation", 7, members=[{"type": "way", "ref": 2, "role": "x"}])]


@pytest.mark.parametrize("suffix", ["o5m", "osm", "pbf"])
def test_files(spark, tmp_path, suffix):
    path = str(tmp_path / f"f.{suffix}")
    tio.write_osm(objects(spark, ROWS), path, [(0.0, 1.0, 2.0, 3.0)], by_id=True)
    got = tio.read_osm(spark, path).orderBy("seq").collect()
    assert [(r.type, r.id) for r in got] == [("node", 1), ("node", 3), ("node", 3), ("way", 2), ("relation", 7)]
    assert got[1].tags == {"a": "1", "b": "2"} and got[3].refs == [3, 3, 1] and got[4].members[0].role == "x"
    assert C.find_bbox(tio.read_osm(spark, path, "bounds")).first().x2 == pytest.approx(2.0)
    assert tio.read_osm(spark, path, types="way").count() == 1
    with pytest.raises(ValueError):
        tio.format_of("f.osc")


def test_cli(spark, tmp_path):
    a, b = str(tmp_path / "a.osm"), str(tmp_path / "b.o5m")
    tio.write_osm(objects(spark, ROWS), a)
    tio.convert(spark, a, b, sort=True)
    assert [r.id for r in tio.read_osm(spark, b).orderBy("seq").collect()] == [1, 3, 3, 2, 7]


def test_convert_keeps_all_bounds(spark, tmp_path):
    a, b = str(tmp_path / "a.osm"), str(tmp_path / "b.o5m")
    tio.write_osm(objects(spark, ROWS), a, [(0.0, 1.0, 2.0, i / 100) for i in range(1500)])
    tio.convert(spark, a, b)
    found = tio.read_osm(spark, b, "bounds")
    assert found.count() == 1500 and C.find_bbox(found).first().y2 == pytest.approx(14.99)


def test_dedup_and_empty(spark):
    o = objects(spark, ROWS)
    got = C.dedup_first(o).filter("type = 'node' and id = 3").collect()
    assert len(got) == 1 and got[0].lat == 1.5
    assert C.find_bbox(spark.createDataFrame([], "seq long, min_lon double, min_lat double, max_lon double, max_lat double")).first().found is False
    many = objects(spark, [blank("node", 1, lat=float(i), tags={"k": str(i)}) for i in range(50)]).repartition(5)
    assert [(r.lat, r.tags) for r in C.dedup_first(many).collect()] == [(0.0, {"k": "0"})] and C.dedup_first(many).columns == many.columns
    box = spark.createDataFrame([(s, float(s), 0.0, 1.0, 1.0) for s in (1, 2, 9)], "seq long, min_lon double, min_lat double, max_lon double, max_lat double")
    assert [C.find_bbox(box, *x).first().x1 for x in ((), (o.filter("seq >= 3"),), (o.filter("false"),))] == [9.0, 2.0, 9.0]
    assert C.find_bbox(box, o).first().found is False
    assert C.count_by_type(o.filter("false")).count() == 0 and C.type_transitions(o.filter("false")).count() == 0
    assert C.type_transitions(o).count() == 4


def test_change_blocks(spark):
    rows = [(1, 1, True, False), (2, 1, False, True), (3, 2, True, False), (4, 2, False, True), (5, 3, False, False), (6, 0, True, False)]
    got = C.change_blocks(spark.createDataFrame(rows, "seq long, version long, visible boolean, if_unused boolean")).orderBy("seq").collect()
    assert [(r.action, r.block_no, r.if_unused) for r in got] == [("create", 0, False), ("create", 0, False), ("modify", 1, False), ("delete", 2, True), ("delete", 2, True), ("create", 3, False)]


def test_latest_across_buckets(spark):
    d = spark.createDataFrame([(i, i if i in (0, 7) else None) for i in range(20)], "n long, v long").repartition(3)
    assert [r.x for r in C.latest(d, "v", "n", "x", 4).orderBy("n").collect()] == [0] * 7 + [7] * 13


def test_planning_maps_files(tmp_path):
    from terraframe.sources.formats import O5mReader, PbfReader, _mapped

    (tmp_path / "empty.pbf").write_bytes(b"")
    with _mapped(str(tmp_path / "empty.pbf")) as m:
        assert m == b""
    assert PbfReader({"path": str(tmp_path / "empty.pbf")}, OBJECT).partitions() == []
    (tmp_path / "bad.o5m").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        O5mReader({"path": str(tmp_path / "bad.o5m")}, OBJECT).partitions()


def test_limits_and_scalars(spark):
    with pytest.raises(ValueError):
        C.parse_limits({"max_fun": 1})
    with pytest.raises(ValueError):
        C.parse_limits({"max_depth": -1})
    assert C.parse_limits({"max_members_per_object": 4, "max_way_nodes_per_object": 2})["max_way_nodes_per_object"] == 2
    with pytest.raises(Exception, match="WAYNODES_MAXIMUM limit exceeded; maximum is 2, got 3"):
        C.enforce_limits(objects(spark, ROWS), {"max_way_nodes_per_object": 2}).collect()
    r = spark.range(1).select(X.grid(F.lit(26.843647754711284)).alias("g"), X.fixed_e7(F.lit(26.843647754711284)).alias("e"), X.lenient_long(F.lit("{}")).alias("l"), F.size(X.split_plain(F.lit("a,b,"), ",")).alias("n"), F.size(X.split_plain(F.lit(""), ",")).alias("z")).first()
    assert (r.g, r.e, r.l, r.n, r.z) == (268436477, 268436478, 0, 2, 0)


def test_stream(spark, tmp_path):
    from terraframe.streaming.feeds import dedup_stream, read_arriving

    tio.write_osm(objects(spark, ROWS), str(tmp_path / "in" / "a.osm"))
    q = dedup_stream(read_arriving(spark, str(tmp_path / "in"), "*.osm")).writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("got").count() == 4


OSC = b"""<osmChange version="0.6"><create><node id="1" version="1" lat="1" lon="2"/><way id="4" version="2"><nd ref="1"/></way></create><delete if-unused="true"><node id="9" version="3"/></delete></osmChange>"""


def test_change_documents_in_memory_and_arriving(spark, tmp_path):
    from terraframe.streaming.feeds import _decode, change_counts, read_arriving

    want = [(0, "create", False, 0, "node", 1), (0, "create", False, 1, "way", 4), (1, "delete", True, 0, "node", 9)]
    columns = ("block_no", "action", "if_unused", "pos", "type", "id")
    assert [tuple(r) for r in tio.from_bytes(spark, OSC, "osm_change").select(*columns).collect()] == want
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.osc").write_bytes(OSC)
    tio.write_osm(objects(spark, ROWS), str(tmp_path / "in" / "b.osm"))
    got = read_arriving(spark, str(tmp_path / "in"))
    for name, d, mode in (("rows", got, "append"), ("counts", change_counts(got, "arrived"), "complete")):
        q = d.writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = spark.table("rows")
    assert [tuple(r) for r in rows.filter("action is not null").orderBy("seq").select(*columns).collect()] == want
    assert rows.filter("action is null").count() == len(ROWS)
    assert {r.action: r.n for r in spark.table("counts").groupBy("action").sum("n").toDF("action", "n").collect()} == {"create": 2 + len(ROWS), "delete": 1}
    with pytest.raises(ValueError, match="no format"):
        _decode("file:/x.xml", b"")

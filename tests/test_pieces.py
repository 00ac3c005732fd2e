"""Files are read by pieces, and in Arrow batches, with the rows of a file read whole."""

import random

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql.pandas.types import to_arrow_schema
from test_codecs import EVERY

from terraframe import io as tio
from terraframe.operators import core as C
from terraframe.plans import queries as Q
from terraframe.schema import CHANGE, OBJECT, blank
from terraframe.sources import batches, o5m, pbf, xml
from terraframe.sources.formats import ChangeReader, O5mReader, PbfReader, XmlReader

SF = f"{DATA}/sf0.001"
ODD = [
    '<way id="7"><tag k="a>b" v="x />"/>text > and /> more<nd ref="1"></nd></way>', "<node id='8' lat='1' lon='2'/>", "<x><node id='9'/><y/></x>", "<note>a > b</note>",
    '<bounds minlat="1" minlon="2" maxlat="3" maxlon="4"/>', '<relation id="3"><member type="way" ref="7" role="&lt;é>"/></relation\n>', "<meta/>",
]


def by_pieces(doc, change=False):
    got = []
    found = xml.pieces(doc)
    for begin, end, root, before in found:
        own = list(xml.decode_piece(doc[:root], [doc[begin:end]], end == len(doc), change))
        assert before == sum(e[0] == "open" for e in got) or not change
        got += own
    return len(found), got


@pytest.mark.parametrize("scan", [300, 1 << 20])
def test_xml_pieces_hold_what_the_file_holds(monkeypatch, scan):
    monkeypatch.setattr(xml, "PIECE", 200)
    monkeypatch.setattr(xml, "SCAN", scan)
    rnd = random.Random(3)
    for head, tail in (('<?xml version="1.0" encoding="UTF-8"?>\n<osm a=">" b=\'"\'>', "</osm>\n"), ("<osm>", "</osm>")):
        doc = (head + "".join(rnd.choice(ODD) + rnd.choice(["", "\n", " > "]) for _ in range(200)) + tail).encode()
        n, got = by_pieces(doc)
        assert n > 5 and got == list(xml.decode([doc]))
    parts = [f"<{a}{u}>{''.join(rnd.choice(ODD) for _ in range(rnd.randrange(4)))}</{a}>" for a in rnd.choices(["create", "delete", "odd"], k=90) for u in [rnd.choice(["", ' if-unused="true"'])]]
    doc = ("<osmChange>" + "".join(rnd.choice([p, p + "<modify/>"]) for p in parts) + "</osmChange>").encode()
    n, got = by_pieces(doc, True)
    assert n > 5 and got == list(xml.decode([doc], True))


@pytest.mark.parametrize("part", ["<!-- <node id='1'/> -->", "<![CDATA[<node>]]>", "<?x <a> ?>"])
def test_xml_is_read_whole_where_tags_are_ambiguous(monkeypatch, part):
    monkeypatch.setattr(xml, "PIECE", 200)
    doc = ("<osm>" + '<node id="1" lat="1" lon="1"/>' * 50 + part + "</osm>").encode()
    assert xml.pieces(doc) == [] and xml.pieces(doc.replace(part.encode(), b"")) != []
    for bad in (b"<osm/>", b"<osm>" * 100, doc.decode().encode("utf-16"), b'<?xml version="1.0" encoding="x-unknown"?>' + doc, b"<osm>" + b"<a>" * 100 + b"</osm>"):
        assert xml.pieces(bad) == []


def test_xml_malformed_pieces_fail(monkeypatch):
    monkeypatch.setattr(xml, "PIECE", 200)
    good = '<way id="1"><nd ref="1"/></way>'
    for bad in ("<way><nd></way></nd>", "<way>&nothing;</way>", "</osm><osm>"):
        doc = ("<osm>" + good * 20 + bad + good * 20 + "</osm>").encode()
        with pytest.raises(Exception, match="error|mismatched|undefined|junk"):
            by_pieces(doc)


def test_large_xml_and_change_files_have_many_partitions(spark, tmp_path):
    path = str(tmp_path / "big.osm")
    with open(path, "w") as f:
        f.write(xml.prolog(bounds=[(1, 2, 3, 4)]))
        f.writelines(xml.element(blank("way", i, refs=[i, i + 1], tags={"k": "é>" * 20})) for i in range(60_000))
        f.write(xml.EPILOG)
    assert len(XmlReader({"path": path}, OBJECT).partitions()) > 1
    got = tio.read_osm(spark, path)
    assert got.rdd.getNumPartitions() > 1 and [r.id for r in got.orderBy("seq").select("id").collect()] == list(range(60_000))
    assert tio.read_osm(spark, path, "header").count() == 1 and tio.read_osm(spark, path, "bounds").count() == 1
    assert len(XmlReader({"path": path, "max_objects": "5"}, OBJECT).partitions()) == len(XmlReader({"path": path, "mode": "permissive"}, OBJECT).partitions()) == 1
    path = str(tmp_path / "big.osc")
    with open(path, "w") as f:
        f.writelines(xml.change_document(((["create", "delete"][i % 2], False, [blank("node", 2 * i), blank("node", 2 * i + 1)]) for i in range(30_000))))
    assert len(ChangeReader({"path": path}, CHANGE).partitions()) > 1
    got = tio.read_change(spark, path)
    assert [tuple(r) for r in got.select("id", "block_no", "pos", "is_diff").orderBy("id").collect()] == [(i, i // 2, i % 2, True) for i in range(60_000)]
    assert tio.read_change(spark, path, compat="reference").filter("is_diff").count() == 2
    assert [r.block_no for r in tio.read_change(spark, path, "blocks").orderBy("block_no").collect()] == list(range(30_000))


def test_batches_hold_rows():
    rows = [r | {"seq": i} for i, r in enumerate(EVERY * 3)]
    schema = to_arrow_schema(OBJECT)
    got = list(batches.of_rows(iter(rows), OBJECT))
    assert all(b.schema == schema for b in got) and list(batches.to_rows(got)) == rows
    assert list(batches.to_rows([b.slice(2, 9) for b in got])) == rows[2:11]
    nulls = pa.RecordBatch.from_pylist([{"type": "node", "id": 1, "uid": None, "user": "a", "tags": None}, {"type": "way", "id": 2, "uid": 5, "user": None, "tags": [("a", "b")]}], pa.schema([schema.field(n) for n in ("type", "id", "uid", "user", "tags")]))
    assert list(batches.to_rows([nulls])) == [blank("node", 1, user="a", tags=None), blank("way", 2, uid=5, tags={"a": "b"})]
    assert batches._array([[1], None, []], pa.list_(pa.int64())).to_pylist() == [[1], None, []]


@pytest.mark.parametrize("number", [None, "seq"])
def test_change_blocks_across_buckets(spark, number):
    """Blocks and flags are those of one pass, wherever buckets begin."""
    rnd = random.Random(5)
    for n in (1, 40, 90):
        rows = []
        for i in range(n):
            v, visible = rnd.choice([(1, True), (2, True), (2, False)]) if not rows or rnd.random() < 0.3 else rows[-1][1:3]
            rows.append((i + 3 if number else 3 * i, v, visible, rnd.choice([True, False, None])))
        want, block, last, flag = [], -1, None, False
        for seq, v, visible, unused in rows:
            act = "create" if v <= 1 else "modify" if visible else "delete"
            if act != last:
                block, last, flag = block + 1, act, bool(unused)
            want.append((seq, act, block, flag if act == "delete" else False))
        d = spark.createDataFrame(rows, "seq long, version long, visible boolean, if_unused boolean").repartition(3)
        got = C.change_blocks(d, number, 4).orderBy("seq")
        assert got.schema["block_no"].dataType.simpleString() == "int"
        assert [tuple(r) for r in got.select("seq", "action", "block_no", "if_unused").collect()] == want


def test_round_trips_sort_once(spark):
    """The writer's own sort is the only range partitioning of the objects."""
    assert not [f for f in Q._full(spark, SF).inputFiles() if "table-" in f]


def test_o5m_and_pbf_pieces_are_groups(tmp_path):
    """Many resets and small blobs don't make a task each."""
    rows = [blank("way", i, refs=[i, 2 * i], tags={"k": str(i % 9)}) for i in range(6000)]
    o = o5m.header() + b"".join(x for i in range(0, 6000, 10) for x in o5m.body(rows[i : i + 10])) + o5m.FOOTER
    p = pbf.frame("OSMHeader", pbf.encode_header()) + b"".join(x for i in range(0, 6000, 10) for x in pbf.encode_blobs(rows[i : i + 10]))
    for data, reader in ((o, O5mReader), (p, PbfReader)):
        path = str(tmp_path / reader.__name__)
        with open(path, "wb") as f:
            f.write(data)
        r = reader({"path": path}, OBJECT)
        pieces = r.partitions()
        assert len(pieces) == 1
        assert [x["id"] for piece in pieces for x in r.rows(piece)] == [*range(6000)]
    assert len(o5m.segments(o)) == 601

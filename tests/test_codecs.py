import random

import pytest

from terraframe.schema import blank
from terraframe.sources import o5m, pbf, xml
from terraframe.sources.wire import Reader, varint, zigzag

EVERY = [
    blank("node", -5, lat=26.843647754711284, lon=-0.5, tags={"a": "x<&>'\"\ny", "é": ""}, version=3, timestamp=1_600_000_000, changeset=9, uid=7, user="ann"),
    blank("node", 8, lat=0.0, lon=180.0, version=2, timestamp=1_600_000_100, changeset=4, uid=0, user="bo", visible=False),
    blank("way", 4, refs=[8, -5, 8, 2**40], tags={"k": "v"}),
    blank("way", 5),
    blank("relation", 1, members=[{"type": "way", "ref": 4, "role": ""}, {"type": "node", "ref": 8, "role": "r"}, {"type": "relation", "ref": -3, "role": "r"}], tags={"t": "u"}),
]


@pytest.mark.parametrize("v,h", [(5, "05"), (127, "7f"), (323, "c302"), (16384, "808001")])
def test_varint(v, h):
    assert varint(v).hex() == h and Reader(bytes.fromhex(h)).varint() == v


@pytest.mark.parametrize("v,h", [(4, "08"), (64, "8001"), (-2, "03"), (-3, "05"), (-65, "8101")])
def test_zigzag(v, h):
    assert zigzag(v).hex() == h and Reader(bytes.fromhex(h)).zigzag() == v


def test_varint_faults():
    with pytest.raises(ValueError, match="too long"):
        Reader(b"\xff" * 11).varint()
    with pytest.raises(ValueError, match="underflow"):
        Reader(b"\x80").varint()


def rows(events):
    return [v[0] for k, *v in events if k == "object"]


def encode_o5m(rs):
    return o5m.header(bounds=[(1, 2, 3, 4)]) + b"".join(o5m.body(rs)) + o5m.FOOTER


def near(a, b, by):
    for x, y in zip(a, b, strict=True):
        for c in x:
            if c in ("lat", "lon") and x[c] is not None:
                assert abs(x[c] - y[c]) <= by
            else:
                assert x[c] == y[c], c


def test_o5m_round_trip():
    kept = [r | {"visible": True} for r in EVERY]
    events = list(o5m.decode(encode_o5m(EVERY)))
    assert ("bounds", (1.0, 2.0, 3.0, 4.0)) in events
    near(kept, rows(events), 5.1e-8)
    assert rows(o5m.decode(encode_o5m([blank("node", 1, version=0, timestamp=5, user="x")])))[0]["timestamp"] == 0


def test_o5m_strict_roles_and_header():
    with pytest.raises(ValueError, match="too short"):
        list(o5m.decode(encode_o5m(EVERY), strict_roles=True))
    with pytest.raises(ValueError, match="not an o5m"):
        list(o5m.decode(b"xx"))


@pytest.mark.parametrize("n", range(243, 256))
def test_o5m_table_limit(n):
    """Pairs of up to 250 bytes are referred to, longer ones repeated."""
    r = [blank("node", i, tags={"foo": "x" * (n - 3)}) for i in range(2)]
    data = encode_o5m(r)
    assert data.count(b"x" * (n - 3)) == (1 if n <= 250 else 2)
    assert [x["tags"] for x in rows(o5m.decode(data))] == [x["tags"] for x in r]


def test_o5m_table_evicts():
    r = [blank("node", i, tags={"k": str(i % 15_001)}) for i in range(30_010)]
    assert [x["tags"] for x in rows(o5m.decode(encode_o5m(r)))] == [x["tags"] for x in r]


def test_o5m_random():
    rnd = random.Random(7)
    r = [blank("way", rnd.randrange(-(2**50), 2**50), refs=[rnd.randrange(-(2**40), 2**40) for _ in range(rnd.randrange(9))], tags={str(rnd.randrange(50)): "v" * rnd.randrange(300)}) for _ in range(300)]
    assert rows(o5m.decode(encode_o5m(r))) == r


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("options", [{}, {"granularity": 1000, "lat0": 500, "lon0": -700, "date": 1000}, {"historical": True}, {"per_group": 1}])
def test_pbf_round_trip(compress, options):
    data = pbf.frame("OSMHeader", pbf.encode_header((1.0, 2.0, 3.0, 4.0)), compress) + pbf.frame("Other", b"zz", compress)
    for kind in ("node", "way", "relation"):
        data += b"".join(pbf.encode_blobs([r for r in EVERY if r["type"] == kind], compress, **options))
    events = list(pbf.decode(data))
    assert events[1] == ("bounds", pytest.approx((1.0, 2.0, 3.0, 4.0)))
    near(EVERY if options.get("historical") else [r | {"visible": True} for r in EVERY], rows(events), 1e-6 if "granularity" in options else 1e-7)


def test_pbf_no_meta_and_faults():
    got = rows(pbf.decode(b"".join(pbf.encode_blobs(EVERY[:1], meta=False))))[0]
    assert got["version"] == 0 and got["user"] == ""
    with pytest.raises(OverflowError):
        list(pbf.encode_blobs([blank("node", 1, uid=2**31)]))
    with pytest.raises(ValueError, match="compression"):
        pbf.inflate(b"\x22\x01a")


def test_pbf_string_table_order():
    order, _ = pbf.string_table([blank("node", 1, tags={"b": "a", "c": "a"})], False)
    assert order == ["", "a", "b", "c"]


def test_xml_round_trip():
    text = xml.prolog({"note": "x"}, [(1, 2, 3, 4)]) + "".join(map(xml.element, EVERY)) + xml.EPILOG
    for size in (1, 7, 10_000):
        raw = text.encode()
        events = list(xml.decode(raw[i : i + size] for i in range(0, len(raw), size)))
        assert events[0] == ("bounds", (1.0, 2.0, 3.0, 4.0))
        near(EVERY, rows(events), 1e-9)


def test_xml_lenient_and_permissive():
    doc = b'<osm><node id="12x" changeset="{}" lat="1.5z" action="y"><tag k="a" v="1"/><tag k="a" v="2"/></node><note/><way id="3"'
    got = list(xml.decode([doc], permissive=True))
    assert got[0][1]["id"] == 12 and got[0][1]["changeset"] == 0 and got[0][1]["lat"] == 1.5 and got[0][1]["tags"] == {"a": "2"}
    with pytest.raises(Exception, match="unclosed"):
        list(xml.decode([doc]))


@pytest.mark.parametrize(
    "option,most,doc",
    [
        ("max_objects", 1, b'<osm><node id="1"/><node id="2"/></osm>'),
        ("max_tags_per_object", 1, b'<osm><node id="1"><tag k="a" v=""/><tag k="a" v=""/></node></osm>'),
        ("max_way_nodes_per_object", 1, b'<osm><way id="1"><nd ref="1"/><nd ref="2"/></way></osm>'),
        ("max_relation_members_per_object", 1, b'<osm><relation id="1"><member ref="1"/><member ref="2"/></relation></osm>'),
        ("max_members_per_object", 1, b'<osm><way id="1"><nd ref="1"/><nd ref="2"/></way></osm>'),
        ("max_depth", 2, b'<osm><way id="1"><nd ref="1"/></way></osm>'),
        ("max_attributes_per_element", 2, b'<osm><node id="1" lat="1" lon="1"/></osm>'),
        ("max_attribute_bytes", 7, b'<osm><node id="12"/></osm>'),
        ("max_bytes", 10, b"<osm></osm >"),
    ],
)
def test_limits(option, most, doc):
    with pytest.raises(xml.LimitError, match="limit exceeded"):
        list(xml.decode([doc], limits={option: most}))
    list(xml.decode([doc], limits={option: most + 1 if option not in ("max_bytes",) else 12}))
    list(xml.decode([doc], limits={option: 0}))


def test_change_document():
    text = "".join(xml.change_document([("create", False, EVERY), ("delete", True, EVERY)], write_if_unused=True))
    got = list(xml.decode([text.encode()], change=True))
    assert [x[1:] for x in got if x[0] == "open"] == [("create", False), ("delete", True)]
    kinds = [x[1]["type"] for x in got if x[0] == "object"]
    assert kinds == ["node", "node", "way", "way", "relation", "relation", "way", "way", "node", "node"]
    assert "".join(xml.change_document([("modify", False, EVERY)], separate=True)).count("<modify>") == len(EVERY)

"""Queries over map-shaped views of the driver's tables, by name, with DuckDB SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..io import read_change, read_osm, write_change, write_osm
from ..operators import core as C
from ..schema import CHANGE, DEFAULTS, OBJECT
from ..session import shared_folder
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{V.WITH} {sql}" if not sql.lstrip().startswith("with") else f"{V.WITH}, {sql.lstrip()[5:]}"
        return f

    return put


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, sf_dir).select("type", "id", "seq") for f in (V.nodes, V.ways, V.relations)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ALL = "select type, id, seq from nodes union all select type, id, seq from ways union all select type, id, seq from relations"
BLOCKS = """c as (select *, case when version <= 1 then 'create' when visible then 'modify' else 'delete' end as action from edits),
  b as (select *, sum(case when action is distinct from prev then 1 else 0 end) over (order by seq) - 1 as block_no from (select *, lag(action) over (order by seq) as prev from c))"""


@query(f"select type, count(*) as n from ({ALL}) group by type")
def count_by_type(s, d):
    return C.count_by_type(_objects(s, d))


@query("select id, seq, event_id from edits qualify row_number() over (partition by type, id order by seq) = 1")
def dedup_first(s, d):
    return C.dedup_first(V.edits(s, d)).select("id", "seq", "event_id")


@query("select id, cast(day as varchar) as day, seq, event_id from edits qualify row_number() over (partition by type, id, day order by seq) = 1")
def dedup_epochs(s, d):
    return C.dedup_first(V.edits(s, d), "day").select("id", F.col("day").cast("string").alias("day"), "seq", "event_id")


@query(f"select type, id, row_number() over (order by case type when 'node' then 0 when 'way' then 1 else 2 end, id, seq) as pos from ({ALL})")
def sort_by_type_id(s, d):
    o = _objects(s, d).withColumn("rank", C.type_rank())
    return C.ordered(o, "rank", "id", "seq").select("type", "id", (F.col("__row") + 1).alias("pos"))


@query("""select count(*) > 0 as found, coalesce(arg_max(a, seq), 0.0) as x1, coalesce(arg_max(b, seq), 0.0) as y1, coalesce(arg_max(c, seq), 0.0) as x2, coalesce(arg_max(e, seq), 0.0) as y2
  from (select seq, lon - 1 as a, lat - 1 as b, lon + 1 as c, lat + 1 as e from nodes)""")
def find_bbox_last(s, d):
    n = V.nodes(s, d)
    return C.find_bbox(n.select("seq", (F.col("lon") - 1).alias("min_lon"), (F.col("lat") - 1).alias("min_lat"), (F.col("lon") + 1).alias("max_lon"), (F.col("lat") + 1).alias("max_lat")))


@query("select distinct id from nodes")
def node_ids(s, d):
    return C.object_ids(V.nodes(s, d), "node")


@query("select distinct id from ways")
def way_ids(s, d):
    return C.object_ids(V.ways(s, d), "way")


@query("select distinct id from relations")
def relation_ids(s, d):
    return C.object_ids(V.relations(s, d), "relation")


@query("select id, array_to_string(list_sort(list_distinct(refs)), ',') as refs from ways")
def way_ref_ids(s, d):
    return V.ways(s, d).select("id", F.array_join(C.ref_ids(), ",").alias("refs"))


@query("select seq, id, case when version <= 1 then 'create' when visible then 'modify' else 'delete' end as action from edits")
def change_classify(s, d):
    return V.edits(s, d).select("seq", "id", C.action().alias("action"))


@query(f"with {BLOCKS} select seq, action, cast(block_no as bigint) as block_no from b")
def change_blocks(s, d):
    return C.change_blocks(V.edits(s, d)).select("seq", "action", F.col("block_no").cast("long").alias("block_no"))


@query(f"with {BLOCKS} select cast(block_no as bigint) as block_no, action, count(*) as n from b group by block_no, action")
def change_block_counts(s, d):
    return C.change_blocks(V.edits(s, d)).groupBy(F.col("block_no").cast("long").alias("block_no"), "action").agg(F.count("*").alias("n"))


@query(f"""with {BLOCKS}, t as (select *, case seq % 3 when 0 then 'node' when 1 then 'way' else 'relation' end as kind from b)
  select seq, row_number() over (order by block_no, case action when 'delete' then 2 - (case kind when 'node' then 0 when 'way' then 1 else 2 end) else (case kind when 'node' then 0 when 'way' then 1 else 2 end) end, seq) as pos from t""")
def change_output_order(s, d):
    e = C.change_blocks(V.edits(s, d)).withColumn("type", F.when(F.col("seq") % 3 == 0, "node").when(F.col("seq") % 3 == 1, "way").otherwise("relation"))
    return C.ordered(e.withColumn("rank", C.output_rank()), "block_no", "rank", "seq").select("seq", (F.col("__row") + 1).alias("pos"))


@query("""with g as (select id, (id - 1) // 8000 as grp, cast(round(lat * 1e7) as bigint) as lat, cast(round(lon * 1e7) as bigint) as lon from nodes)
  select id, id - coalesce(lag(id) over w, 0) as d_id, lat - coalesce(lag(lat) over w, 0) as d_lat, lon - coalesce(lag(lon) over w, 0) as d_lon from g window w as (partition by grp order by id)""")
def delta_encode_nodes(s, d):
    g = V.nodes(s, d).select("id", F.expr("(id - 1) div 8000").alias("grp"), X.fixed_e7("lat").alias("lat"), X.fixed_e7("lon").alias("lon"))
    return C.delta_encode(g, ["id", "lat", "lon"], ["grp"], "id").select("id", "d_id", "d_lat", "d_lon")


@query("select id, cast(round(lat * 1e7) as bigint) as lat, cast(round(lon * 1e7) as bigint) as lon from nodes")
def delta_decode_nodes(s, d):
    g = V.nodes(s, d).select("id", F.col("id").alias("k"), F.expr("(id - 1) div 8000").alias("grp"), X.fixed_e7("lat").alias("lat"), X.fixed_e7("lon").alias("lon"))
    e = C.delta_encode(g, ["id", "lat", "lon"], ["grp"], "k").select("k", "grp", "d_id", "d_lat", "d_lon")
    return C.delta_decode(e, ["id", "lat", "lon"], ["grp"], "k").select("id", "lat", "lon")


@query("select id, array_to_string(list_transform(range(1, len(refs) + 1), lambda i: refs[i] - case when i = 1 then 0 else refs[i - 1] end), ',') as deltas from ways")
def delta_refs_per_way(s, d):
    return V.ways(s, d).select("id", F.array_join(C.delta_array("refs"), ",").alias("deltas"))


@query("select id, array_to_string(refs, ',') as refs from ways")
def undelta_refs_per_way(s, d):
    return V.ways(s, d).select("id", C.delta_array("refs").alias("x")).select("id", F.array_join(C.undelta_array("x"), ",").alias("refs"))


@query("""with f as (select id, unnest(refs) as ref, unnest(range(len(refs))) as i from ways)
  select id, i as pos, ref - coalesce(lag(ref) over (order by id, i), 0) as delta from f""")
def delta_refs_running(s, d):
    f = V.ways(s, d).select("id", F.posexplode("refs").alias("pos", "ref"))
    f = C.delta_running(C.ordered(f, "id", "pos"), "ref", "__row", "delta")
    return f.select("id", F.col("pos").cast("long").alias("pos"), "delta")


_DELTA = "(select id, cast(round(lat * 1e7) as bigint) as v from nodes)"


def _values(s, d):
    return V.nodes(s, d).select("id", X.fixed_e7("lat").alias("v"))


@query(f"select id, v, case when v >= 0 then 2 * v else -2 * v - 1 end as z from {_DELTA}")
def zigzag(s, d):
    return _values(s, d).select("id", "v", X.zigzag("v").alias("z"))


@query(f"select id, v from {_DELTA}")
def unzigzag(s, d):
    return _values(s, d).select("id", X.unzigzag(X.zigzag("v")).alias("v"))


@query(f"select id, cast(greatest(1, ceil(length(bin(case when v >= 0 then 2 * v else -2 * v - 1 end)) / 7.0)) as bigint) as n from {_DELTA}")
def varint_len(s, d):
    return _values(s, d).select("id", X.varint_len(X.zigzag("v")).cast("long").alias("n"))


@query("""with z as (select id, case when v >= 0 then 2 * v else -2 * v - 1 end as z from """ + _DELTA + """),
  n as (select id, z, cast(greatest(1, ceil(length(bin(z)) / 7.0)) as bigint) as n from z)
  select id, lower(array_to_string(list_transform(range(n), lambda i: lpad(hex((z // (cast(1 as bigint) << (7 * i))) % 128 + case when i < n - 1 then 128 else 0 end), 2, '0')), '')) as h from n""")
def varint_hex(s, d):
    return _values(s, d).select("id", X.varint_hex(X.zigzag("v")).alias("h"))


@query(f"select id, v from {_DELTA}")
def varint_roundtrip(s, d):
    return _values(s, d).select("id", X.unzigzag(X.unvarint(X.varint(X.zigzag("v")))).alias("v"))


@query("select id, cast(round(lat * 1e7) as bigint) as lat_e7, cast(round(lon * 1e7) as bigint) as lon_e7 from nodes")
def fixed_e7(s, d):
    return V.nodes(s, d).select("id", X.fixed_e7("lat").alias("lat_e7"), X.fixed_e7("lon").alias("lon_e7"))


@query("select id, cast(trunc(round(lat / 1e-9::double) / 100) as bigint) as lat, cast(trunc(round(lon / 1e-9::double) / 100) as bigint) as lon from nodes")
def pbf_grid(s, d):
    return V.nodes(s, d).select("id", X.grid("lat").alias("lat"), X.grid("lon").alias("lon"))


@query("select id, 1e-9::double * (0 + 100 * cast(trunc(round(lat / 1e-9::double) / 100) as bigint)) as lat from nodes")
def grid_to_deg(s, d):
    return V.nodes(s, d).select("id", X.from_grid(X.grid("lat")).alias("lat"))


@query("""with t as (select (id - 1) // 1000 as block, unnest(['brand', 'name', 'size', 'type', coalesce(p_brand, ''), coalesce(p_name, ''), coalesce(cast(p_size as varchar), ''), coalesce(p_type, '')]) as s from nodes),
  n as (select block, s, count(*) as n from t group by block, s) select block, s, n, row_number() over (partition by block order by n desc, encode(s)) as idx from n""")
def string_table(s, d):
    t = V.nodes(s, d).select(F.expr("(id - 1) div 1000").alias("block"), F.explode(F.concat(F.map_keys("tags"), F.map_values("tags"))).alias("s"))
    return C.string_table(t)


@query(f"""select type, id, row, row // 1000 as block, (row % 1000) // 100 as grp from
  (select type, id, row_number() over (partition by type order by seq) - 1 as row from ({ALL}))""")
def block_pack(s, d):
    return C.block_pack(_objects(s, d), 100, dict.fromkeys(("node", "way", "relation"), 1000)).select("type", "id", "row", "block", "grp")


@query("select id, strlen('name') + strlen(coalesce(p_name, '')) <= 250 as eligible from nodes")
def o5m_table_eligible(s, d):
    return V.nodes(s, d).select("id", (F.octet_length(F.lit("name")) + F.octet_length(F.col("tags")["name"]) <= 250).alias("eligible"))


_ESC = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&', '&amp;'), '''', '&apos;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;'), chr(10), '&#10;')"


@query(f"select doc_id, md5({_ESC('text')}) as h from documents")
def xml_escape(s, d):
    return V.read(s, d, "documents").select("doc_id", F.md5(X.xml_escape("text").cast("binary")).alias("h"))


def _tag_xml(tags):
    return F.array_join(F.transform(C.tag_entries(tags), lambda e: F.concat(F.lit('    <tag k="'), X.xml_escape(e["key"]), F.lit('" v="'), X.xml_escape(e["value"]), F.lit('" />\n'))), "")


@query(f"""select id, printf('  <node id="%d" visible="true" lat="%.9f" lon="%.9f">', id, lat, lon) || chr(10) || '    <tag k="brand" v="' || {_ESC("coalesce(p_brand, '')")} || '" />' || chr(10)
  || '    <tag k="name" v="' || {_ESC("coalesce(p_name, '')")} || '" />' || chr(10) || '    <tag k="size" v="' || coalesce(cast(p_size as varchar), '') || '" />' || chr(10)
  || '    <tag k="type" v="' || {_ESC("coalesce(p_type, '')")} || '" />' || chr(10) || '  </node>' || chr(10) as xml from nodes""")
def node_xml(s, d):
    return V.nodes(s, d).select("id", F.concat(F.format_string('  <node id="%d" visible="true" lat="%.9f" lon="%.9f">\n', "id", "lat", "lon"), _tag_xml("tags"), F.lit("  </node>\n")).alias("xml"))


@query(f"""select id, '  <way id="' || id || '" timestamp="' || strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '"' || case when uid <> 0 then ' uid="' || uid || '"' else '' end || ' visible="true">' || chr(10)
  || array_to_string(list_transform(refs, lambda r: '    <nd ref="' || r || '" />' || chr(10)), '')
  || '    <tag k="priority" v="' || {_ESC('o_orderpriority')} || '" />' || chr(10) || '    <tag k="status" v="' || {_ESC('o_orderstatus')} || '" />' || chr(10) || '  </way>' || chr(10) as xml from ways""")
def way_xml(s, d):
    head = F.concat(F.lit('  <way id="'), F.col("id").cast("string"), F.lit('" timestamp="'), X.epoch_to_iso("timestamp"), F.lit('"'), F.when(F.col("uid") != 0, F.concat(F.lit(' uid="'), F.col("uid").cast("string"), F.lit('"'))).otherwise(""), F.lit(' visible="true">\n'))
    refs = F.array_join(F.transform("refs", lambda r: F.concat(F.lit('    <nd ref="'), r.cast("string"), F.lit('" />\n'))), "")
    return V.ways(s, d).select("id", F.concat(head, refs, _tag_xml("tags"), F.lit("  </way>\n")).alias("xml"))


@query(f"""select id, '  <relation id="' || id || '" visible="true">' || chr(10)
  || array_to_string(list_transform(range(1, len(refs) + 1), lambda i: '    <member type="way" ref="' || refs[i] || '" role="' || roles[i] || '" />' || chr(10)), '')
  || '    <tag k="segment" v="' || {_ESC('c_mktsegment')} || '" />' || chr(10) || '  </relation>' || chr(10) as xml from relations""")
def relation_xml(s, d):
    m = F.array_join(F.transform("members", lambda x: F.concat(F.lit('    <member type="'), x["type"], F.lit('" ref="'), x["ref"].cast("string"), F.lit('" role="'), X.xml_escape(x["role"]), F.lit('" />\n'))), "")
    return V.relations(s, d).select("id", F.concat(F.lit('  <relation id="'), F.col("id").cast("string"), F.lit('" visible="true">\n'), m, _tag_xml("tags"), F.lit("  </relation>\n")).alias("xml"))


@query("select id, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H:%M:%SZ') as iso from ways")
def iso_format(s, d):
    return V.ways(s, d).select("id", X.epoch_to_iso("timestamp").alias("iso"))


@query("select id, timestamp from ways")
def iso_parse(s, d):
    return V.ways(s, d).select("id", X.iso_to_epoch(X.epoch_to_iso("timestamp")).alias("timestamp"))


@query(r"select p_partkey as id, coalesce(try_cast(regexp_extract(p_size || 'x' || p_name, '^\s*([+-]?[0-9]+)', 1) as bigint), 0) as a, coalesce(try_cast(regexp_extract(p_name, '^\s*([+-]?[0-9]+)', 1) as bigint), 0) as b from part")
def lenient_int(s, d):
    return V.read(s, d, "part").select(F.col("p_partkey").alias("id"), X.lenient_long(F.concat(F.col("p_size").cast("string"), F.lit("x"), "p_name")).alias("a"), X.lenient_long("p_name").alias("b"))


@query("select event_id, coalesce(event_type <> 'false', true) as a, coalesce(case when value > 50 then 'false' end <> 'false', true) as b from events")
def lenient_bool(s, d):
    e = V.read(s, d, "events")
    return e.select("event_id", X.lenient_bool("event_type").alias("a"), X.lenient_bool(F.when(F.col("value") > 50, "false")).alias("b"))


@query("""select id, case when version <> 0 then ts else 0 end as timestamp, case when version <> 0 and ts <> 0 then uid else 0 end as uid from
  (select id, uid, id % 3 as version, case when id % 2 = 0 then 0 else timestamp end as ts from ways)""")
def meta_o5m_normalize(s, d):
    w = V.ways(s, d).withColumn("version", F.col("id") % 3).withColumn("timestamp", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("timestamp")))
    w = w.withColumn("changeset", F.lit(0)).withColumn("user", F.lit(""))
    return C.normalize_o5m(w).select("id", "timestamp", "uid")


@query("select seq, kind as type, prev as prev_type from (select seq, kind, lag(kind) over (order by seq) as prev from (select seq, case seq // 7 % 3 when 0 then 'node' when 1 then 'way' else 'relation' end as kind from edits)) where prev is distinct from kind")
def type_transitions(s, d):
    k = F.expr("(seq div 7) % 3")
    e = V.edits(s, d).select("seq", F.when(k == 0, "node").when(k == 1, "way").otherwise("relation").alias("type"))
    return C.type_transitions(e).select("seq", "type", "prev_type")


@query("select 'way' as type, id, seq, 'WAYNODES_MAXIMUM limit exceeded; maximum is 5, got ' || len(refs) as message from ways where len(refs) > 5")
def limit_violations(s, d):
    w = V.ways(s, d).withColumn("members", F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>"))
    return C.limit_violations(w, {"max_way_nodes_per_object": 5, "max_tags_per_object": 2})


@query("select type, pos, 'lat' as problem from (select type, id, row_number() over (order by seq) - 1 as pos from nodes) where id % 5 = 0")
def file_compare(s, d):
    n = V.nodes(s, d).withColumns({"version": F.lit(1), "timestamp": F.lit(0), "changeset": F.lit(0), "uid": F.lit(0), "user": F.lit(""), "refs": F.lit(None).cast("array<bigint>"), "members": F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>")})
    other = n.withColumn("lat", F.col("lat") + F.when(F.col("id") % 5 == 0, 1e-5).when(F.col("id") % 5 == 1, 1e-6).otherwise(0.0))
    return C.compare_files(n, other)


@query("select kind, case kind when 'node' then '0' when 'way' then '1' when 'relation' then '2' end as code, case when kind = 'area' then '' else kind end as back from (select unnest(['node', 'way', 'relation', 'area']) as kind)")
def member_type_codes(s, d):
    k = s.createDataFrame([("node",), ("way",), ("relation",), ("area",)], "kind string")
    return k.select("kind", X.member_code("kind").cast("string").alias("code"), X.member_type(X.member_code("kind")).alias("back"))


@query("select id, 'brand=' || coalesce(p_brand, '') || chr(10) || 'name=' || coalesce(p_name, '') || chr(10) || 'size=' || coalesce(cast(p_size as varchar), '') || chr(10) || 'type=' || coalesce(p_type, '') as tags from nodes")
def print_tags(s, d):
    return V.nodes(s, d).select("id", C.print_tags().alias("tags"))


@query("select id, timestamp * 1000 // 250 as units, (timestamp * 1000 // 250) * 250 // 1000 as back from ways")
def date_granularity(s, d):
    u = X.to_date_units("timestamp", 250)
    return V.ways(s, d).select("id", u.alias("units"), X.from_date_units(u, 250).alias("back"))


def _through(s: SparkSession, objects: DataFrame, fmt: str, **options) -> DataFrame:
    """objects written as one file, by type and id, and read again."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}.{fmt}"
    write_osm(objects, path, [(1.0, 2.0, 3.0, 4.0)], fmt, by_id=True, **options)
    return read_osm(s, path, fmt=fmt)


def _full(s: SparkSession, d: str) -> DataFrame:
    """Objects of all types; seq is the place in a type's own table."""
    nodes, ways, relations = (f(s, d) for f in (V.nodes, V.ways, V.relations))
    o = nodes.unionByName(ways, True).unionByName(relations, True)
    for c, v in DEFAULTS.items():
        o = o.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in o.columns else F.lit(v))
    return o.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OBJECT.fields])


_ROUND = """select type, id, cast(round(lat * 1e7) as bigint) as lat, {uid} as uid, cast(null as varchar) as refs, p_name as tag from nodes
  union all select type, id, null, {way_uid}, array_to_string(refs, ','), o_orderstatus from ways union all select type, id, null, {uid}, array_to_string(refs, ','), c_mktsegment from relations"""


def _digest(o: DataFrame) -> DataFrame:
    refs = F.when(F.col("type") == "way", F.array_join("refs", ",")).when(F.col("type") == "relation", F.array_join(F.transform("members", lambda m: m["ref"]), ","))
    tag = F.coalesce(*[F.col("tags")[k] for k in ("name", "status", "segment")])
    return o.select("type", "id", F.when(F.col("type") == "node", X.fixed_e7("lat")).alias("lat"), "uid", refs.alias("refs"), tag.alias("tag"))


@query(_ROUND.format(uid="0", way_uid="0"))
def roundtrip_o5m(s, d):
    """Without a version the format keeps no uid."""
    return _digest(_through(s, _full(s, d), "o5m"))


@query(_ROUND.format(uid="0", way_uid="uid"))
def roundtrip_xml(s, d):
    return _digest(_through(s, _full(s, d), "osm_xml"))


@query(_ROUND.format(uid="0", way_uid="uid").replace("cast(round(lat * 1e7) as bigint)", "cast(trunc(round(lat / 1e-9::double) / 100) as bigint)"))
def roundtrip_pbf(s, d):
    return _digest(_through(s, _full(s, d), "osm_pbf", max_block_objects=2000))


@query(f"with {BLOCKS} select cast(block_no as bigint) as block_no, action, id, version from b")
def roundtrip_change(s, d):
    e = C.change_blocks(V.edits(s, d), "seq").withColumn("pos", F.col("seq")).withColumn("is_diff", F.lit(True))
    have = {"lat": F.lit(0.0), "lon": F.lit(0.0)}
    rows = e.select(*[(F.col(f.name) if f.name in e.columns else have.get(f.name, F.lit(DEFAULTS.get(f.name)))).cast(f.dataType).alias(f.name) for f in CHANGE.fields])
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}.osc"
    write_change(rows, path)
    return read_change(s, path).select(F.col("block_no").cast("long").alias("block_no"), "action", "id", "version")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

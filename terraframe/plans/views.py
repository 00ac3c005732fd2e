"""Map-shaped views of the driver's tables, in exact arithmetic so that Spark and SQL agree to the bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import ordered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lat = (((k * 7919) % 1800000001) - 900000000) / F.lit(1e7)
    lon = (((k * 104729) % 3600000001) - 1800000000) / F.lit(1e7)
    tags = F.create_map(*[x for t, c in (("brand", "p_brand"), ("name", "p_name"), ("size", "p_size"), ("type", "p_type")) for x in (F.lit(t), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    return read(spark, sf_dir, "part").select(F.lit("node").alias("type"), k.alias("id"), k.alias("seq"), lat.alias("lat"), lon.alias("lon"), tags.alias("tags"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("x"))
    o = read(spark, sf_dir, "orders")
    d = o.join(items, o["o_orderkey"] == items["l_orderkey"])
    return d.select(F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("uid"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.transform("x", lambda r: r["l_partkey"]).alias("refs"), F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus").alias("tags"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    c = read(spark, sf_dir, "customer")
    d = c.join(m, c["c_custkey"] == m["o_custkey"], "left")
    members = F.transform(F.coalesce("x", F.array()), lambda r: F.struct(F.lit("way").alias("type"), r["o_orderkey"].alias("ref"), r["o_orderstatus"].alias("role")))
    return d.select(F.lit("relation").alias("type"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"), members.alias("members"), F.create_map(F.lit("segment"), "c_mktsegment").alias("tags"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    e = ordered(read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id", name="seq")
    version = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select((F.col("seq") + 1).alias("seq"), "event_id", F.lit("node").alias("type"), F.col("user_id").alias("id"), version.alias("version"), F.coalesce(F.col("event_type") != "error", F.lit(True)).alias("visible"), F.to_date("ts").alias("day"), "ts")


NODES = """select 'node' as type, p_partkey as id, p_partkey as seq, (((p_partkey * 7919) % 1800000001) - 900000000) / 1e7::double as lat,
  (((p_partkey * 104729) % 3600000001) - 1800000000) / 1e7::double as lon, p_brand, p_name, p_size, p_type from part"""
WAYS = """select 'way' as type, o_orderkey as id, o_orderkey as seq, o_custkey as uid, cast(floor(epoch(o_orderdate)) as bigint) as timestamp, refs, o_orderpriority, o_orderstatus
  from orders join (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as refs from lineitem group by l_orderkey) on o_orderkey = l_orderkey"""
RELATIONS = """select 'relation' as type, c_custkey as id, c_custkey as seq, coalesce(refs, []) as refs, coalesce(roles, []) as roles, c_mktsegment
  from customer left join (select o_custkey, list(o_orderkey order by o_orderkey, o_orderstatus) as refs, list(o_orderstatus order by o_orderkey, o_orderstatus) as roles from orders group by o_custkey) on c_custkey = o_custkey"""
EDITS = """select row_number() over (order by ts, event_id) as seq, event_id, 'node' as type, user_id as id,
  row_number() over (partition by user_id order by ts, event_id) as version, coalesce(event_type <> 'error', true) as visible, cast(ts as date) as day, ts from events"""
WITH = f"with nodes as ({NODES}), ways as ({WAYS}), relations as ({RELATIONS}), edits as ({EDITS})"

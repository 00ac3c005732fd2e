"""Operators over tables of map objects (schema.OBJECT) and change blocks: DataFrame and SQL functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import limit_message
from ..schema import DEFAULTS
from ..session import materialize


def type_rank(kind: Column | str = "type") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind == "node", 0).when(kind == "way", 1).when(kind == "relation", 2).otherwise(3)


def with_defaults(objects: DataFrame) -> DataFrame:
    """Absent metadata as the values that stand for it."""
    return objects.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(objects.schema[c].dataType)) for c, v in DEFAULTS.items() if c in objects.columns})


# --- order without one task: numbers and running values over the whole input --------------------------


def ordered(df: DataFrame, *keys: str, name: str = "__row") -> DataFrame:
    """Numbers rows from 0 in the order of keys over the whole table. Rows are range-partitioned and sorted, numbered in their partition
    and written to the shared folder (planning a range again could cut it elsewhere); counts of partitions, one small row each, give
    where each begins. No task sees more than its partition."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    d = d.withColumn("__part", F.shiftright("__id", 33)).withColumn("__pos", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    d = materialize(d)
    counts = d.groupBy("__part").agg(F.count("*").alias("__n"))
    begins = counts.withColumn("__begin", F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).select("__part", F.coalesce("__begin", F.lit(0)).alias("__begin"))
    return d.join(F.broadcast(begins), "__part").withColumn(name, F.col("__begin") + F.col("__pos")).drop("__part", "__pos", "__id", "__begin")


def running(df: DataFrame, value: str, order: str, name: str, buckets: int = 1 << 16) -> DataFrame:
    """Running sum of value over the whole table in the order of a row number: within buckets of rows first, then the sums of buckets
    are added, so the only unpartitioned window has a row a bucket."""
    b = df.withColumn("__b", F.expr(f"cast({order} div {buckets} as long)"))
    sums = b.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inner = F.sum(value).over(W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return b.withColumn("__inner", inner).join(before, "__b").withColumn(name, F.col("__inner") + F.col("__before")).drop("__b", "__inner", "__before")


def latest(df: DataFrame, value: str, order: str, name: str, buckets: int = 1 << 16) -> DataFrame:
    """The last value so far that isn't null, over the whole table in the order of a row number: within buckets of rows first, as in
    running()."""
    b = df.withColumn("__b", F.expr(f"cast({order} div {buckets} as long)"))
    tails = b.groupBy("__b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__t"))
    before = tails.withColumn("__before", F.last("__t", True).over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).drop("__t")
    inner = F.last(value, True).over(W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return b.withColumn("__inner", inner).join(before, "__b").withColumn(name, F.coalesce("__inner", "__before")).drop("__b", "__inner", "__before")


def previous(df: DataFrame, columns: list[str], order: str, buckets: int = 1 << 16) -> DataFrame:
    """Adds __prev_<c>: the value in the row before, over the whole table, in the order of a row number without gaps."""
    b = df.withColumn("__b", F.expr(f"cast({order} div {buckets} as long)"))
    tails = b.groupBy("__b").agg(F.max_by(F.struct(*columns), order).alias("__tail")).withColumn("__b", F.col("__b") + 1)
    w = W.partitionBy("__b").orderBy(order)
    first = F.row_number().over(w) == 1
    out = b.withColumns({f"__lag_{c}": F.lag(c).over(w) for c in columns} | {"__first": first}).join(tails, "__b", "left")
    return out.withColumns({f"__prev_{c}": F.when(F.col("__first"), F.col(f"__tail.{c}")).otherwise(F.col(f"__lag_{c}")) for c in columns}).drop("__b", "__tail", "__first", *[f"__lag_{c}" for c in columns])


# --- filters -------------------------------------------------------------------------------------------


def find_bbox(bounds: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """One row: found and the last declared bounds (x1, y1, x2, y2); zeros if none were declared. With the objects of the same input,
    only bounds that stand before the first of them count."""
    if objects is not None:
        first = objects.agg(F.min("seq").alias("__first"))  # one row
        bounds = bounds.join(F.broadcast(first), F.col("__first").isNull() | (F.col("seq") < F.col("__first")), "left_semi")
    last = bounds.agg(F.max_by(F.struct("min_lon", "min_lat", "max_lon", "max_lat"), "seq").alias("b"))
    names = {"x1": "min_lon", "y1": "min_lat", "x2": "max_lon", "y2": "max_lat"}
    return last.select(F.col("b").isNotNull().alias("found"), *[F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(n) for n, c in names.items()])


def dedup_first(objects: DataFrame, *epoch: str) -> DataFrame:
    """The first object by seq of each (type, id), and of each epoch if given. A hot key keeps one row a map task, so no group is
    collected."""
    keys = ["type", "id", *epoch]
    rest = [c for c in objects.columns if c not in keys]
    least = objects.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("__r"))
    return least.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in objects.columns])


def sort_objects(objects: DataFrame) -> DataFrame:
    """Nodes, ways, relations, each by id; input order decides ties. Ids stay as they are."""
    return objects.orderBy(type_rank(), "id", "seq")


def replay(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Typed tables as one, in the order of types."""
    return nodes.unionByName(ways, True).unionByName(relations, True).orderBy(type_rank(), "seq")


def split_types(objects: DataFrame) -> dict[str, DataFrame]:
    return {k: objects.filter(F.col("type") == k) for k in ("node", "way", "relation")}


def is_empty(objects: DataFrame, bounds: DataFrame) -> bool:
    return objects.isEmpty() and bounds.isEmpty()


# --- changes -------------------------------------------------------------------------------------------


def action(version: Column | str = "version", visible: Column | str = "visible") -> Column:
    version, visible = (F.col(x) if isinstance(x, str) else x for x in (version, visible))
    return F.when(version <= 1, "create").when(visible, "modify").otherwise("delete")


def change_blocks(edits: DataFrame, number: str | None = None, buckets: int = 1 << 16) -> DataFrame:
    """Adds action, block_no (from 0) and if_unused. Consecutive edits by seq with one action share a block; if_unused is that of the
    edit that opens a delete block, false elsewhere. number: a column that already numbers the edits in the order of seq, without gaps.

    Within buckets of edits one window tells which open a block, the first one's case left open; a row a bucket then says whether its
    first edit opens one, how many blocks and which flag come before."""
    e = edits.withColumn("action", action())
    if "if_unused" not in e.columns:
        e = e.withColumn("if_unused", F.lit(False))
    e = e.withColumn("if_unused", F.coalesce("if_unused", F.lit(False)))
    e = materialize(e.withColumn("__row", F.col(number))) if number else ordered(e, "seq")
    e = e.withColumn("__b", F.expr(f"cast(__row div {buckets} as long)"))
    w = W.partitionBy("__b").orderBy("__row")
    e = e.withColumn("__opens", F.coalesce(F.lag("action").over(w) != F.col("action"), F.lit(False)).cast("long"))
    e = e.withColumn("__told", F.when(F.col("__opens") == 1, F.col("if_unused")))
    told = F.max_by("__told", F.when(F.col("__opens") == 1, F.col("__row")))
    b = e.groupBy("__b").agg(F.sum("__opens").alias("__n"), F.min_by(F.struct("action", "if_unused"), "__row").alias("__head"), F.max_by("action", "__row").alias("__tail"), told.alias("__last"))
    over = W.orderBy("__b")  # a row a bucket
    b = b.withColumn("__first", F.coalesce(F.lag("__tail").over(over) != F.col("__head.action"), F.lit(True)))
    b = b.withColumn("__end", F.coalesce("__last", F.when(F.col("__first"), F.col("__head.if_unused"))))
    before = over.rowsBetween(W.unboundedPreceding, -1)
    flag = F.when(F.col("__first"), F.col("__head.if_unused")).otherwise(F.last("__end", True).over(before))
    base = F.coalesce(F.sum(F.col("__n") + F.col("__first").cast("long")).over(before), F.lit(0)) + F.col("__first").cast("long") - 1
    b = b.select("__b", base.alias("__base"), flag.alias("__flag"))
    inner = w.rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumns({"__inner": F.sum("__opens").over(inner), "__told": F.last("__told", True).over(inner)}).join(b, "__b")
    e = e.withColumn("block_no", (F.col("__base") + F.col("__inner")).cast("int"))
    e = e.withColumn("if_unused", F.when(F.col("action") == "delete", F.coalesce("__told", "__flag")).otherwise(F.lit(False)))
    return e.drop("__row", "__b", "__opens", "__told", "__inner", "__base", "__flag")


def append_block(changes: DataFrame, objects: DataFrame, act: str, if_unused: bool = False) -> DataFrame:
    """objects as one more block behind those of changes."""
    last = changes.agg(F.coalesce(F.max("block_no"), F.lit(-1)).alias("__last"))
    new = objects.withColumnRenamed("seq", "pos").crossJoin(F.broadcast(last)).withColumn("block_no", (F.col("__last") + 1).cast("int")).drop("__last")  # one row
    new = new.withColumns({"action": F.lit(act), "if_unused": F.lit(if_unused), "is_diff": F.lit(True)})
    return changes.unionByName(new, allowMissingColumns=True)


def output_rank(act: Column | str = "action", kind: Column | str = "type") -> Column:
    """Place of a type within its block: deletes go from relations to nodes."""
    act = F.col(act) if isinstance(act, str) else act
    return F.when(act == "delete", 2 - type_rank(kind)).otherwise(type_rank(kind))


# --- aggregates ----------------------------------------------------------------------------------------


def object_ids(objects: DataFrame, kind: str) -> DataFrame:
    return objects.filter(F.col("type") == kind).select("id").distinct()


def ref_ids(refs: Column | str = "refs") -> Column:
    return F.array_sort(F.array_distinct(refs))


def count_by_type(objects: DataFrame) -> DataFrame:
    return objects.groupBy("type").agg(F.count("*").alias("n"))


def string_table(strings: DataFrame, block: str = "block", value: str = "s") -> DataFrame:
    """(block, s, n, idx): strings of each block by falling frequency, then bytes; index 0 is kept for the empty string."""
    counts = strings.groupBy(block, value).agg(F.count("*").alias("n"))
    return counts.withColumn("idx", F.row_number().over(W.partitionBy(block).orderBy(F.desc("n"), value)).cast("long"))


def object_strings(objects: DataFrame, with_meta: bool = True) -> Column:
    """The strings of an object that a block's table counts."""
    parts = [F.coalesce(F.map_keys("tags"), F.array()), F.coalesce(F.map_values("tags"), F.array())]
    parts += [F.array(F.coalesce("user", F.lit("")))] * with_meta
    return F.concat(*parts, F.coalesce(F.transform("members", lambda m: m["role"]), F.array()))


PER_BLOCK = {"node": 1_200_000, "way": 200_000, "relation": 100_000}


def block_pack(objects: DataFrame, per_group: int = 8000, per_block: dict[str, int] | None = None) -> DataFrame:
    """Adds row (in its type, from 0), block and grp (in its block), by seq. Types are numbered at once: their counts are known from
    the numbering of the whole, so no window spans a type."""
    sizes = per_block or PER_BLOCK
    d = ordered(objects.withColumn("__rank", type_rank()), "__rank", "seq")
    first = d.groupBy("__rank").agg(F.min("__row").alias("__first"))
    d = d.join(F.broadcast(first), "__rank").withColumn("row", F.col("__row") - F.col("__first"))
    size = F.coalesce(*[F.when(F.col("type") == k, F.lit(n)) for k, n in sizes.items()], F.lit(min(sizes.values())))
    d = d.withColumn("block", F.floor(F.col("row") / size)).withColumn("grp", F.floor((F.col("row") % size) / per_group))
    return d.drop("__rank", "__first", "__row")


# --- deltas --------------------------------------------------------------------------------------------


def delta_encode(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """Adds d_<c>: the difference to the row before within keys; the first one's is its value."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"d_{c}": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in columns})


def delta_decode(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """The inverse: d_<c> back to <c>."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(f"d_{c}").over(w) for c in columns})


def delta_array(refs: Column | str) -> Column:
    """Differences within an array."""
    refs = F.col(refs) if isinstance(refs, str) else refs
    return F.transform(refs, lambda x, i: x - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(refs, i - 1)))


def undelta_array(d: Column | str) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.aggregate(d, F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long")) + x))


def delta_running(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """name: the difference of value to the row before over the whole table, as streams without resets have it; order numbers rows."""
    d = previous(df, [value], order)
    return d.withColumn(name, F.col(value) - F.coalesce(f"__prev_{value}", F.lit(0))).drop(f"__prev_{value}")


def split_zero(keys_vals: list[int]) -> list[list[tuple[int, int]]]:
    """(key value)* 0 runs; a run that no 0 ends is left out."""
    out, own, i = [], [], 0
    while i < len(keys_vals):
        if keys_vals[i] > 0 and i + 1 < len(keys_vals):
            own.append((keys_vals[i], keys_vals[i + 1]))
            i += 2
        else:
            out.append(own)
            own = []
            i += 1
    return out


def type_transitions(objects: DataFrame) -> DataFrame:
    """Objects whose type differs from the one before, the first included."""
    d = previous(ordered(objects, "seq"), ["type"], "__row")
    return d.filter(F.col("__prev_type").isNull() | (F.col("__prev_type") != F.col("type"))).drop("__row").withColumnRenamed("__prev_type", "prev_type")


# --- limits --------------------------------------------------------------------------------------------

LIMITS = {
    "max_bytes": "XML_UPLOAD_MAXIMUM_BYTES", "max_depth": "PGMAP_XML_MAX_DEPTH", "max_objects": "CHANGESETS_MAXIMUM_ELEMENTS", "max_tags_per_object": "PGMAP_XML_MAX_TAGS_PER_OBJECT",
    "max_way_nodes_per_object": "WAYNODES_MAXIMUM", "max_relation_members_per_object": "RELATION_MEMBERS_MAXIMUM", "max_attributes_per_element": "PGMAP_XML_MAX_ATTRIBUTES_PER_ELEMENT", "max_attribute_bytes": "PGMAP_XML_MAX_ATTRIBUTE_BYTES",
}


def parse_limits(options: dict) -> dict[str, int]:
    """Limits by name, 0 for none. max_members_per_object stands for ways' nodes and relations' members, unless these are given."""
    out = dict.fromkeys(LIMITS, 0)
    for name in sorted(options):
        value = int(options[name])
        if value < 0:
            raise ValueError(f"limit {name} is negative")
        if name == "max_members_per_object":
            out["max_way_nodes_per_object"] = out["max_relation_members_per_object"] = value
        elif name in LIMITS:
            out[name] = value
        else:
            raise ValueError(f"unknown limit {name}")
    return out


def limit_violations(objects: DataFrame, limits: dict) -> DataFrame:
    """(type, id, seq, message) of each object over a limit of its own."""
    m = parse_limits(limits)
    own = {"max_tags_per_object": F.size("tags"), "max_way_nodes_per_object": F.when(F.col("type") == "way", F.size("refs")), "max_relation_members_per_object": F.when(F.col("type") == "relation", F.size("members"))}
    checks = [F.when(c > m[k], limit_message(LIMITS[k], m[k], c)) for k, c in own.items() if m[k]]
    if not checks:
        return objects.select("type", "id", "seq", F.lit("").alias("message")).filter("false")
    return objects.select("type", "id", "seq", F.explode(F.array_compact(F.array(*checks))).alias("message"))


def enforce_limits(objects: DataFrame, limits: dict) -> DataFrame:
    """objects, failing on the first one over a limit of its own."""
    m = parse_limits(limits)
    d = objects
    for k, c in {"max_tags_per_object": F.size("tags"), "max_way_nodes_per_object": F.size("refs"), "max_relation_members_per_object": F.size("members")}.items():
        if m[k]:
            d = d.withColumn("seq", F.when(c > m[k], F.raise_error(limit_message(LIMITS[k], m[k], c)).cast("long")).otherwise(F.col("seq")))
    return d


# --- metadata and comparison -----------------------------------------------------------------------------


def normalize_o5m(objects: DataFrame) -> DataFrame:
    """What metadata the o5m format keeps: none without a version; no changeset, uid and user without a timestamp."""
    v, t = F.col("version") != 0, (F.col("version") != 0) & (F.col("timestamp") != 0)
    zero = F.lit(0).cast("long")
    return objects.withColumns({"timestamp": F.when(v, F.col("timestamp")).otherwise(zero), "changeset": F.when(t, F.col("changeset")).otherwise(zero), "uid": F.when(t, F.col("uid")).otherwise(zero), "user": F.when(t, F.col("user")).otherwise(""), "visible": F.lit(True), "current": F.lit(True)})


def tag_entries(tags: Column | str = "tags") -> Column:
    """Sorted (key, value): maps can't be compared, arrays can."""
    return F.array_sort(F.map_entries(tags))


def print_tags(tags: Column | str = "tags") -> Column:
    return F.array_join(F.transform(tag_entries(tags), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n")


def compare_files(a: DataFrame, b: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """(type, pos, problem) of each difference, objects taken by place within their type. visible isn't compared, a missing changeset is
    0, coordinates may differ by tolerance, tags are compared as maps, refs and members in order."""

    def placed(d: DataFrame, x: str) -> DataFrame:
        d = block_pack(with_defaults(d), per_block=dict.fromkeys(("node", "way", "relation"), 1 << 62))
        keep = {c: F.col(c) for c in ("id", "version", "timestamp", "changeset", "uid", "user", "lat", "lon", "refs", "members")} | {"tags": tag_entries()}
        return d.select("type", F.col("row").alias("pos"), F.struct(*[e.alias(c) for c, e in keep.items()]).alias(x))

    both = placed(a, "a").join(placed(b, "b"), ["type", "pos"], "full")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    near = lambda c: same(c) | (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance)
    attributes = [~F.coalesce(near(c) if c in ("lat", "lon") else same(c), F.lit(False)) for c in ("id", "version", "timestamp", "changeset", "uid", "user", "lat", "lon", "refs", "members", "tags")]
    names = ("id", "version", "timestamp", "changeset", "uid", "user", "lat", "lon", "refs", "members", "tags")
    problem = F.when(F.col("a").isNull(), F.array(F.lit("missing in first"))).when(F.col("b").isNull(), F.array(F.lit("missing in second"))).otherwise(F.array_compact(F.array(*[F.when(p, F.lit(n)) for p, n in zip(attributes, names)])))
    return both.select("type", "pos", F.explode(problem).alias("problem"))

"""The semantic graph: entities, typed edges, their constraints, manifests.

Accepting rows is set-based: membership is a left semi join, duplicates are ranked by input order, and every
reject is a row with its reason. Reasons are tested in order: membership, domain, duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which kinds of edges may link which kinds of entities.
RELATIONS = (("produces", "observation", "data-object"), ("derived-from", "data-object", "product"), ("derived-from", "product", "product"))
ENTITY_TYPES = ("observation", "data-object", "product", "process-record")
PROVENANCE_KINDS = ("used", "generated")
AXES = ("x", "y", "band", "time", "polarization")
# Names of entity types in messages.
ENTITY_NAMES = {"observation": "Observation", "data-object": "DataObject", "product": "Product", "process-record": "ProcessRecord"}


def allowed(kind: Column, src_type: Column, dst_type: Column) -> Column:
    out = F.lit(False)
    for k, s, d in RELATIONS:
        out = out | ((kind == k) & (src_type == s) & (dst_type == d))
    return out


def with_ids(rows: DataFrame, order: str, keys: list[str], name: str = "id") -> DataFrame:
    """Ids from 0 in input order, within keys (a scene)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def added(existing: DataFrame, rows: DataFrame, order: str, keys: list[str], name: str = "id") -> DataFrame:
    """existing and rows, which get the next ids of their scene in input order. Each kind of entity is a table with ids of its own."""
    last = existing.groupBy(*keys).agg((F.max(name) + 1).alias("_next"))
    fresh = with_ids(rows, order, keys, name).join(last, keys, "left")
    return existing.unionByName(fresh.withColumn(name, F.col(name) + F.coalesce("_next", F.lit(0))).drop("_next"))


def by_id(entities: DataFrame, wanted: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """wanted (keys, name) with the entity's columns; found is false where there is none: NOT_FOUND."""
    return wanted.join(entities.withColumn("found", F.lit(True)), [*keys, name], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def at_place(entities: DataFrame, wanted: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """Likewise by position (column place, from 0) in order of id; found is false beyond the end: OUT_OF_RANGE."""
    placed = entities.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(name)) - 1).cast("bigint"))
    return by_id(placed, wanted.withColumn("place", F.col("place").cast("bigint")), keys, "place")


def entity_name(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ENTITY_NAMES.items() for x in kv)), kind)


def members(edges: DataFrame, entities: DataFrame, type_col: str, id_col: str, invert: bool = False) -> DataFrame:
    """edges whose end is an entity of its scene; or those whose end is not."""
    e = entities.select(F.col("scene_id"), F.col("entity_type").alias(type_col), F.col("entity_id").alias(id_col))
    return edges.join(e, ["scene_id", type_col, id_col], "left_anti" if invert else "left_semi")


def _marked(edges: DataFrame, entities: DataFrame, type_col: str, id_col: str, name: str) -> DataFrame:
    e = entities.select("scene_id", F.col("entity_type").alias(type_col), F.col("entity_id").alias(id_col)).distinct().withColumn(name, F.lit(True))
    return edges.join(e, ["scene_id", type_col, id_col], "left")


def _place(*keys: str) -> Column:
    """A row's place among those of equal keys, by ordinal. Rows are sorted by a hash first, so most compare by one number."""
    return F.row_number().over(Window.partitionBy(F.xxhash64(*keys), *keys).orderBy("ordinal"))


def judged_relationships(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges with reason: null if accepted, else not-found, invalid-domain or duplicate."""
    rows = _marked(_marked(edges, entities, "src_type", "src_id", "_src"), entities, "dst_type", "dst_id", "_dst")
    fine = F.col("_src").isNotNull() & F.col("_dst").isNotNull() & allowed(F.col("kind"), F.col("src_type"), F.col("dst_type"))
    place = _place("scene_id", "src_type", "src_id", "kind", "dst_type", "dst_id")
    reason = F.when(F.col("_src").isNull() | F.col("_dst").isNull(), "not-found").when(~fine, "invalid-domain").when(place > 1, "duplicate")
    return rows.withColumn("reason", reason).drop("_src", "_dst")


def judged_provenance(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Likewise for process-to-entity edges, without a domain; cycles are accepted."""
    processes = entities.where("entity_type = 'process-record'")
    rows = edges.withColumn("_type", F.lit("process-record"))
    rows = _marked(_marked(rows, processes, "_type", "process_id", "_p"), entities, "entity_type", "entity_id", "_e")
    place = _place("scene_id", "process_id", "kind", "entity_type", "entity_id")
    reason = F.when(F.col("_p").isNull() | F.col("_e").isNull(), "not-found").when(place > 1, "duplicate")
    return rows.withColumn("reason", reason).drop("_type", "_p", "_e")


def attached(external: DataFrame, keys: list[str], order: str) -> DataFrame:
    """external ids with reason: one for each image and namespace, the first; empty parts are refused."""
    empty = (F.length("namespace") == 0) | (F.length("value") == 0) | (F.coalesce(F.length("version"), F.lit(1)) == 0)
    place = F.row_number().over(Window.partitionBy(*keys, "namespace").orderBy(empty.cast("int"), order))
    return external.withColumn("reason", F.when(empty, "empty").when(place > 1, "duplicate"))


def same_external_id(a: DataFrame | str, b: str) -> Column:
    """Of two aliases: namespace and value equal, versions equal or both absent."""
    c = lambda x, n: F.col(f"{x}.{n}")
    return (c(a, "namespace") == c(b, "namespace")) & (c(a, "value") == c(b, "value")) & c(a, "version").eqNullSafe(c(b, "version"))


def axis_problem(axes: Column, kind: Column, extent: Column) -> Column:
    """Why an axis can't be appended: null if it can."""
    return F.when(~kind.isin(*AXES), "unknown kind").when(extent < 1, "extent below 1").when(F.exists(axes, lambda a: a["kind"] == kind), "duplicate kind")


def with_axis(axes: Column, kind: Column, extent: Column) -> Column:
    return F.when(axis_problem(axes, kind, extent).isNull(), F.array_append(axes, F.struct(kind.alias("kind"), extent.alias("extent")))).otherwise(axes)


def axis(axes: Column, kind: Column) -> Column:
    """The axis of a kind, or null."""
    return F.try_element_at(F.filter(axes, lambda a: a["kind"] == kind), F.lit(1))


def edges_of(edges: DataFrame, side: str, entity_type: str, entity_id: int | Column) -> DataFrame:
    """Edges from (src) or to (dst) an entity, in order."""
    return edges.where((F.col(f"{side}_type") == entity_type) & (F.col(f"{side}_id") == entity_id)).orderBy("ordinal")


def domains(tables: dict[str, DataFrame]) -> DataFrame:
    """entity_type of every entity, one row each: not distinct."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("entity_type"))
        out = rows if out is None else out.unionByName(rows)
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    return domains(tables).groupBy("entity_type").agg(F.count("*").alias("n"))


def manifest(relationships: DataFrame, provenance: DataFrame, data_objects: DataFrame, version: int = 1) -> DataFrame:
    """scene_id, manifest: a struct whose members are in canonical order, for to_json; no images, cameras or external ids."""
    ref = lambda t, i: F.struct(F.col(t).alias("entity"), F.col(i).alias("id"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c.alias("v")))), lambda x: x["v"])
    r = relationships.groupBy("scene_id").agg(ordered(F.struct(F.col("kind"), ref("src_type", "src_id").alias("source"), ref("dst_type", "dst_id").alias("target"))).alias("relationships"))
    process = F.struct(F.lit("process-record").alias("entity"), F.col("process_id").alias("id"))
    p = provenance.groupBy("scene_id").agg(ordered(F.struct(ref("entity_type", "entity_id").alias("entity"), F.col("kind"), process.alias("process"))).alias("provenance"))
    d = data_objects.groupBy("scene_id").agg(ordered(F.struct(F.transform("axes", lambda a: F.struct(a["extent"].alias("extent"), a["kind"].alias("kind"))).alias("axes"))).alias("data_objects"))
    joined = d.join(r, "scene_id", "full").join(p, "scene_id", "full")
    empty = lambda c: F.coalesce(c, F.array().cast(joined.schema[c].dataType))
    return joined.select("scene_id", F.struct(empty("data_objects").alias("data_objects"), F.struct(F.lit(version).alias("version")).alias("metadata"), empty("provenance").alias("provenance_relations"), empty("relationships").alias("relationships")).alias("manifest"))

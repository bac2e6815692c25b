"""Queries over the test tables, one for each family of operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import fields, geometry, grid, samples
from tesserae.operators import files, graph, kernels, stats
from tesserae.plans import views
from tesserae.plans.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LAYOUTS = "SELECT p_partkey, p_size, p_partkey % 1000 + 64 AS w, p_partkey * 7 % 1000 + 64 AS h, CAST((p_size % 8 + 1) * 16 AS BIGINT) AS t FROM part"
PIXELS = "SELECT vec_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS x, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"
SAMPLES8 = f"SELECT vec_id, x, value, CAST(((CAST(floor(value * 100) AS BIGINT) % 256) + 256) % 256 AS BIGINT) AS q FROM ({PIXELS})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Tile grids


@query(f"SELECT p_partkey, l AS level, ((w >> l) + t - 1) // t AS tile_cols, ((h >> l) + t - 1) // t AS tile_rows FROM ({LAYOUTS}), range(4) AS r(l)")
def tile_columns_rows(spark, sf_dir):
    rows = views.layouts(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3))))
    along = lambda c: grid.tiles_along(F.col(c), F.col("t"), F.col("level"))
    return rows.select("p_partkey", F.col("level").cast("bigint").alias("level"), along("w").alias("tile_cols"), along("h").alias("tile_rows"))


@query(
    f"SELECT p_partkey, c AS tile_col, r AS tile_row, r * ((w + t - 1) // t) + c AS linear_index, c * t AS x, r * t AS y, t AS tile_w, t AS tile_h"
    f" FROM ({LAYOUTS}), range(200) AS a(c), range(200) AS b(r) WHERE c < (w + t - 1) // t AND r < (h + t - 1) // t"
)
def tile_region_for(spark, sf_dir):
    t = F.col("t")
    rows = views.layouts(spark, sf_dir).select("p_partkey", "w", "h", "t", F.explode(grid.grid(F.col("w"), F.col("h"), t, t)).alias("g")).select("p_partkey", "w", "h", "t", "g.*")
    return rows.select("p_partkey", "tile_col", "tile_row", "linear_index", grid.region_in(F.col("tile_col"), F.col("tile_row"), F.col("w"), F.col("h"), t, t).alias("region")).select("p_partkey", "tile_col", "tile_row", "linear_index", "region.*")


@query(f"SELECT p_partkey, w // 2 // t AS tile_col, h // 3 // t AS tile_row FROM ({LAYOUTS})")
def tile_index_for(spark, sf_dir):
    at = grid.tile_of(F.floor(F.col("w") / 2), F.floor(F.col("h") / 3), F.col("t"), F.col("t"))
    return views.layouts(spark, sf_dir).select("p_partkey", at.alias("i")).select("p_partkey", "i.tile_col", "i.tile_row")


@query(f"SELECT p_partkey, ((w + t - 1) // t) * ((h + t - 1) // t) AS tiles, t = 0 AS untiled FROM ({LAYOUTS})")
def tile_total(spark, sf_dir):
    t = F.col("t")
    return views.layouts(spark, sf_dir).select("p_partkey", grid.tile_total(F.col("w"), F.col("h"), t, t).alias("tiles"), grid.untiled(t, t).alias("untiled"))


TYPE_OF_SIZE = "['UInt8','UInt16','Int16','UInt32','Int32','Float32','Float64'][p_size % 7 + 1]"


def _pixel_type():
    return F.element_at(F.array(*(F.lit(n) for n in samples.TYPES)), F.col("p_size") % 7 + 1)


@query(f"SELECT p_partkey, {TYPE_OF_SIZE} AS pixel_type, [1,2,2,4,4,4,8][p_size % 7 + 1] AS sample_bytes, CAST(t * t * 3 * [1,2,2,4,4,4,8][p_size % 7 + 1] AS BIGINT) AS tile_bytes FROM ({LAYOUTS})")
def tile_bytes(spark, sf_dir):
    size = samples.sample_bytes(F.col("pixel_type"))
    rows = views.layouts(spark, sf_dir).withColumn("pixel_type", _pixel_type())
    return rows.select("p_partkey", "pixel_type", size.alias("sample_bytes"), grid.tile_bytes(F.col("t"), F.col("t"), F.lit(3), size).alias("tile_bytes"))


@query(
    f"SELECT p_partkey, pt AS pixel_type, pt NOT LIKE 'Float%' AS is_integer, pt NOT LIKE 'UInt%' AS is_signed, pt LIKE 'Float%' AS is_float, lower(pt) AS name,"
    f" CASE WHEN pt LIKE 'UInt%' THEN 1 WHEN pt LIKE 'Int%' THEN 2 ELSE 3 END AS sample_format, CAST(regexp_extract(pt, '[0-9]+') AS INTEGER) AS bits, pt AS again FROM (SELECT p_partkey, {TYPE_OF_SIZE} AS pt FROM part)"
)
def pixel_type_flags(spark, sf_dir):
    pt = F.col("pixel_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", _pixel_type().alias("pixel_type"))
    form, bits = samples.sample_format(pt), samples.sample_bits(pt)
    return rows.select("p_partkey", "pixel_type", samples.is_integer(pt).alias("is_integer"), samples.is_signed(pt).alias("is_signed"), samples.is_float(pt).alias("is_float"), samples.display_name(pt).alias("name"), form.alias("sample_format"), bits.alias("bits"), samples.from_tiff(form, bits).alias("again"))


# Statistics


@query(f"SELECT vec_id, x // 16 AS tile_col, min(value) AS min_value, max(value) AS max_value, round(avg(value), 9) AS mean_value, count(*) AS n FROM ({PIXELS}) GROUP BY ALL")
def tile_stats(spark, sf_dir):
    rows = stats.tiled(views.pixels(spark, sf_dir), F.lit(16), F.lit(1))
    return stats.channel_stats(rows, ["vec_id", "tile_col"]).withColumn("mean_value", F.round("mean_value", 9))


@query(
    f"WITH p AS (SELECT vec_id, x // 16 AS tile_col, value FROM ({PIXELS})), s AS (SELECT vec_id, tile_col, min(value) AS lo, max(value) AS hi FROM p GROUP BY ALL)"
    " SELECT vec_id, tile_col, CAST(CASE WHEN hi > lo THEN floor(greatest(0, least(1, (value - lo) / (hi - lo))) * 63) ELSE 0 END AS INTEGER) AS bin, count(*) AS n,"
    " CAST(trunc(lo + (hi - lo) * (bin + 0.5) / 64) AS BIGINT) AS label FROM p JOIN s USING (vec_id, tile_col) GROUP BY ALL"
)
def tile_histogram(spark, sf_dir):
    """A tile is a slice of an embedding, so its range is known in its row."""
    tiles = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.expr("(size(embedding) - 1) div 16"))).alias("tile_col"))
    samples_ = F.slice("embedding", (F.col("tile_col") * 16 + 1).cast("int"), 16)
    return stats.array_histogram(tiles.select("vec_id", F.col("tile_col").cast("bigint").alias("tile_col"), samples_.alias("samples")), ["vec_id", "tile_col"], "samples")


@query(f"SELECT vec_id, min(value) AS min_value, max(value) AS max_value, round(avg(value), 9) AS mean_value, count(*) AS n FROM ({PIXELS}) WHERE x // 16 = 37 // 16 GROUP BY ALL")
def pixel_sample_stats(spark, sf_dir):
    """Of the tile that holds pixel (37, 0)."""
    rows = stats.tiled(views.pixels(spark, sf_dir), F.lit(16), F.lit(1)).where(F.col("tile_col") == 37 // 16)
    return stats.channel_stats(rows, ["vec_id"]).withColumn("mean_value", F.round("mean_value", 9))


@query(
    "SELECT l_suppkey, channel, min(v) AS min_value, max(v) AS max_value, round(avg(v), 9) AS mean_value, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT l_suppkey, {i} AS channel, CAST({c} AS DOUBLE) AS v FROM lineitem" for i, c in enumerate(("l_quantity", "l_discount", "l_tax")))
    + ") GROUP BY ALL"
)
def channel_stats_multi(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.posexplode(F.array("l_quantity", "l_discount", "l_tax")).alias("channel", "value"))
    return stats.channel_stats(rows, ["l_suppkey", "channel"]).withColumn("mean_value", F.round("mean_value", 9))


@query(
    "WITH s AS (SELECT event_type, user_id % 5 AS language, list_sort(list(value)) AS v FROM events GROUP BY ALL)"
    " SELECT event_type, language, v[len(v) // 2 + 1] AS median_ms, v[1] AS min_ms, v[len(v)] AS max_ms FROM s"
)
def bench_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("language", F.col("user_id") % 5)
    return stats.timing_summary(rows, ["event_type", "language"], "value")


@query(
    "WITH s AS (SELECT event_type, user_id % 3 AS l, list_sort(list(value)) AS v FROM events GROUP BY ALL), m AS (SELECT event_type, l, v[len(v) // 2 + 1] AS x FROM s)"
    " SELECT event_type, max(x) FILTER (WHERE l = 0) AS l0, max(x) FILTER (WHERE l = 1) AS l1, max(x) FILTER (WHERE l = 2) AS l2 FROM m GROUP BY ALL"
)
def bench_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("l", F.concat(F.lit("l"), (F.col("user_id") % 3).cast("string")))
    return stats.timing_summary(rows, ["event_type", "l"], "value").groupBy("event_type").pivot("l", ["l0", "l1", "l2"]).agg(F.max("median_ms"))


# Sample kernels


@query(f"SELECT vec_id, x, q, ((q - coalesce(lag(q) OVER (PARTITION BY vec_id ORDER BY x), 0)) % 256 + 256) % 256 AS residual FROM ({SAMPLES8})")
def predictor_apply(spark, sf_dir):
    return kernels.predictor_apply(views.samples8(spark, sf_dir), ["vec_id"], "x", "q", 8).select("vec_id", "x", "q", "residual")


@query(
    f"SELECT p_partkey, CAST(8 + coalesce(sum(w * h * [1,2,2,4,4,4,8][p_size % 7 + 1]) OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM ({LAYOUTS})"
)
def image_offsets(spark, sf_dir):
    rows = views.layouts(spark, sf_dir).withColumn("size", F.col("w") * F.col("h") * samples.sample_bytes(_pixel_type())).withColumn("file", F.col("p_partkey") % 10)
    return kernels.offsets(rows, "p_partkey", "size", ["file"], prefix=8).select("p_partkey", "byte_offset")


@query(f"WITH p AS ({PIXELS}) SELECT a.vec_id, o AS ox, CAST(0 AS BIGINT) AS oy, value FROM (SELECT DISTINCT vec_id FROM p) AS a, range(16) AS r(o), p WHERE p.vec_id = a.vec_id AND p.x = o * 64 // 16")
def downsample_nearest(spark, sf_dir):
    pixels = views.pixels(spark, sf_dir)
    sizes = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(64).alias("width"), F.lit(1).alias("height"))
    return kernels.downsample_nearest(pixels, sizes, 16, 1, "vec_id").select("vec_id", F.col("ox").cast("bigint").alias("ox"), F.col("oy").cast("bigint").alias("oy"), "value")


# Metadata maps

KEYS = "(CASE doc_id % 4 WHEN 0 THEN 'image.' || source || '.' || lang WHEN 1 THEN 'image.camera.' || lang WHEN 2 THEN lang || '.x' ELSE 'image.' || lang END)"


@query(
    f"SELECT doc_id, {KEYS} AS key, CASE WHEN NOT starts_with({KEYS}, 'image.') THEN 'not in the namespace' WHEN NOT regexp_matches({KEYS}, '^image\\.[^.]+\\..+$') THEN 'needs a domain and a name'"
    f" WHEN starts_with({KEYS}, 'image.camera.') OR starts_with({KEYS}, 'image.crs.') THEN 'domain is typed' END AS problem FROM documents"
)
def key_validation(spark, sf_dir):
    d, lang = F.col("doc_id") % 4, F.col("lang")
    key = F.when(d == 0, F.concat(F.lit("image."), "source", F.lit("."), lang)).when(d == 1, F.concat(F.lit("image.camera."), lang)).when(d == 2, F.concat(lang, F.lit(".x"))).otherwise(F.concat(F.lit("image."), lang))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).withColumn("problem", fields.key_problem(F.col("key")))


ENTRIES = (
    "SELECT event_id, unnest(['image.spice.frame', 'image.layers.dem', 'image.provenance.software', 'other.key']) AS key,"
    " unnest([event_type, CAST(user_id AS VARCHAR), coalesce(json_extract_string(props, '$.k'), ''), '1']) AS value FROM events"
)


@query(f"SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY key) - 1 AS INTEGER) AS place, key, value FROM ({ENTRIES})")
def fields_sorted(spark, sf_dir):
    return views.field_maps(spark, sf_dir).select("event_id", F.posexplode(fields.in_order(F.col("fields"))).alias("place", "e")).select("event_id", "place", "e.key", "e.value")


@query(f"SELECT event_id, substr(key, 14) AS name, value FROM ({ENTRIES}) WHERE starts_with(key, 'image.layers.')")
def prefix_filter(spark, sf_dir):
    rows = views.field_maps(spark, sf_dir).where(fields.has_domain(F.col("fields"), "layers"))
    return rows.select("event_id", F.explode(fields.domain(F.col("fields"), "layers")).alias("name", "value"))


@query("SELECT event_id, event_type AS frame, 'none' AS instrument, 'v2' AS replaced FROM events")
def field_lookup(spark, sf_dir):
    f = F.col("fields")
    again = fields.upsert(f, F.lit("other.key"), F.lit("v2"))
    return views.field_maps(spark, sf_dir).select("event_id", fields.required(f, "image.spice.frame").alias("frame"), fields.lookup(f, "image.spice.instrument", F.lit("none")).alias("instrument"), fields.lookup(again, "other.key").alias("replaced"))


@query(
    "WITH c AS (SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS raw, c_nationkey FROM customer)"
    " SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'pinhole' END AS model, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(700 + c_nationkey AS DOUBLE) END AS fx,"
    " CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN CAST(c_nationkey AS DOUBLE) ELSE 0.0 END AS position_x, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(0.25 AS DOUBLE) END AS k1 FROM c"
)
def camera_from_fields(spark, sf_dir):
    """A third of the cameras are partial, a third have no pose."""
    c, n = F.col("c_custkey") % 3, F.col("c_nationkey")
    key = lambda k: F.lit(f"image.camera.{k}")
    inner = F.create_map(key("model"), F.lit("pinhole"), key("focal_length_x"), (n + 700).cast("string"), key("principal_x"), F.lit("1.5"), key("principal_y"), F.lit("2"), key("lens_kind"), F.lit("odd"), key("lens.k1"), F.lit("0.25"))
    inner = F.map_concat(inner, F.map_filter(F.create_map(key("focal_length_y"), F.lit("700")), lambda k, v: c != 0))
    pose = F.create_map(*(x for k in ("rotation_w", "rotation_x", "rotation_y", "rotation_z", "position_x", "position_y", "position_z") for x in (key(k), n.cast("string"))))
    f = F.map_concat(inner, F.map_filter(pose, lambda k, v: c == 1))
    rows = table(spark, sf_dir, "customer").select("c_custkey", fields.camera(f).alias("c"))
    return rows.select("c_custkey", "c.model", "c.fx", F.col("c.position.x").alias("position_x"), F.try_element_at(F.col("c.lens.parameters"), F.lit("k1")).alias("k1"))


BODY = "CASE n_nationkey % 4 WHEN 0 THEN '301' WHEN 1 THEN '499' WHEN 2 THEN CAST(n_nationkey AS VARCHAR) ELSE NULL END"


@query(
    f"SELECT n_nationkey, CASE {BODY} WHEN '301' THEN 'Moon' WHEN '499' THEN 'Mars' ELSE coalesce({BODY}, 'Vesta') END AS planet, coalesce({BODY}, '20000004') AS iau_id,"
    f" CASE WHEN n_nationkey % 2 = 0 THEN 'IAU_MOON_2000' ELSE 'UNSPECIFIED' END AS frame, CASE WHEN {BODY} IS NULL THEN 'sinusoidal' ELSE 'equirectangular' END AS projection,"
    f" CASE WHEN {BODY} IS NULL THEN CAST(12.5 AS DOUBLE) END AS lat0 FROM nation"
)
def crs_projection(spark, sf_dir):
    """Registered and older forms."""
    k = F.col("n_nationkey") % 4
    key = lambda n: F.lit(f"image.crs.{n}")
    body = F.when(k == 0, "301").when(k == 1, "499").when(k == 2, F.col("n_nationkey").cast("string"))
    new = F.create_map(key("body"), body, key("reference_frame"), F.when(F.col("n_nationkey") % 2 == 0, "IAU_MOON_2000"))
    old = F.create_map(key("planet_name"), F.lit("Vesta"), key("planet_iau_id"), F.lit("20000004"), key("planet_semi_major_m"), F.lit("285000"), key("planet_semi_minor_m"), F.lit("229000"), key("projection"), F.lit("sinusoidal"), key("param.lat0"), F.lit("12.5"))
    f = F.map_filter(F.when(body.isNull(), old).otherwise(new), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "nation").select("n_nationkey", fields.crs(f).alias("c"))
    return rows.select("n_nationkey", "c.planet", "c.iau_id", "c.frame", F.col("c.projection.kind").alias("projection"), F.try_element_at(F.col("c.projection.parameters"), F.lit("lat0")).alias("lat0"))


@query(
    "SELECT c_custkey, '{\"namespace\":\"' || c_mktsegment || '\",\"value\":\"' || c_name || '\"' || CASE WHEN c_custkey % 2 = 0 THEN ',\"version\":\"' || CAST(c_nationkey AS VARCHAR) || '\"' ELSE '' END || '}' AS json,"
    " CASE WHEN c_custkey % 5 = 0 THEN '\"' || CAST(9007199254740993 + c_custkey AS VARCHAR) || '\"' ELSE CAST(c_custkey AS VARCHAR) END AS number FROM customer"
)
def external_id_json(spark, sf_dir):
    version = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string"))
    n = F.when(F.col("c_custkey") % 5 == 0, F.lit((1 << 53) + 1) + F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", fields.external_id_json(F.col("c_mktsegment"), F.col("c_name"), version).alias("json"), fields.json_number(n).alias("number"))


# The semantic graph

ENTITIES = (
    "SELECT DISTINCT * FROM (SELECT 'observation' AS t, o_orderkey AS i FROM orders UNION ALL SELECT 'data-object', l_orderkey * 10 + l_linenumber FROM lineitem"
    " UNION ALL SELECT 'product', p_partkey FROM part UNION ALL SELECT 'process-record', s_suppkey FROM supplier)"
)
RELATIONS = (
    "SELECT (l_orderkey * 10 + l_linenumber) * 2 AS ordinal, 'observation' AS src_type, CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS src_id, 'produces' AS kind, 'data-object' AS dst_type, l_orderkey * 10 + l_linenumber AS dst_id FROM lineitem"
    " UNION ALL SELECT (l_orderkey * 10 + l_linenumber) * 2 + 1, 'data-object', l_orderkey * 10 + l_linenumber, CASE WHEN l_linenumber = 7 THEN 'produces' ELSE 'derived-from' END, 'product', CASE WHEN l_partkey % 13 = 0 THEN -l_partkey ELSE l_partkey END FROM lineitem"
)
JUDGED = (
    f"WITH e AS ({ENTITIES}), r AS ({RELATIONS}), j AS (SELECT r.*, s.i AS s, d.i AS d, row_number() OVER (PARTITION BY src_type, src_id, kind, dst_type, dst_id ORDER BY ordinal) AS place"
    " FROM r LEFT JOIN e AS s ON s.t = src_type AND s.i = src_id LEFT JOIN e AS d ON d.t = dst_type AND d.i = dst_id), k AS (SELECT *, CASE WHEN s IS NULL OR d IS NULL THEN 'not-found'"
    " WHEN NOT ((kind = 'produces' AND src_type = 'observation' AND dst_type = 'data-object') OR (kind = 'derived-from' AND src_type IN ('data-object', 'product') AND dst_type = 'product')) THEN 'invalid-domain'"
    " WHEN place > 1 THEN 'duplicate' END AS reason FROM j)"
)


# Line items repeat a line number in an order now and then, so ordinals tie; only counts and reasons are compared.
@query(f"{JUDGED} SELECT src_type, src_id, kind, dst_type, dst_id, count(*) AS n FROM k WHERE reason IS NULL GROUP BY ALL")
def relationship_accept(spark, sf_dir):
    entities, relations, _ = views.scene(spark, sf_dir)
    return graph.judged_relationships(relations, entities).where("reason is null").groupBy("src_type", "src_id", "kind", "dst_type", "dst_id").agg(F.count("*").alias("n"))


@query(f"{JUDGED} SELECT src_type, src_id, kind, dst_type, dst_id, reason, count(*) AS n FROM k WHERE reason IS NOT NULL GROUP BY ALL")
def relationship_reject(spark, sf_dir):
    entities, relations, _ = views.scene(spark, sf_dir)
    return graph.judged_relationships(relations, entities).where("reason is not null").groupBy("src_type", "src_id", "kind", "dst_type", "dst_id", "reason").agg(F.count("*").alias("n"))


@query(
    f"WITH e AS ({ENTITIES}), p AS (SELECT CASE WHEN l_suppkey % 17 = 0 THEN -l_suppkey ELSE l_suppkey END AS process_id, CASE WHEN l_linenumber % 2 = 0 THEN 'used' ELSE 'generated' END AS kind, l_partkey AS entity_id FROM lineitem)"
    " SELECT process_id, kind, entity_id, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE t = 'process-record' AND i = process_id) OR NOT EXISTS (SELECT 1 FROM e WHERE t = 'product' AND i = entity_id) THEN 'not-found' END AS problem, count(*) AS n FROM p GROUP BY ALL"
)
def provenance_edges(spark, sf_dir):
    entities, _, provenance = views.scene(spark, sf_dir)
    judged = graph.judged_provenance(provenance, entities)
    return judged.withColumn("problem", F.when(F.col("reason") == "not-found", F.col("reason"))).groupBy("process_id", "kind", "entity_id", "problem").agg(F.count("*").alias("n"))


@query(f"SELECT kind, dst_type, dst_id FROM ({RELATIONS}) WHERE src_type = 'observation' AND src_id = 1")
def edges_from(spark, sf_dir):
    return graph.edges_of(views.scene(spark, sf_dir)[1], "src", "observation", 1).select("kind", "dst_type", "dst_id")


@query(f"SELECT kind, src_type, src_id FROM ({RELATIONS}) WHERE dst_type = 'product' AND dst_id = 7")
def edges_to(spark, sf_dir):
    return graph.edges_of(views.scene(spark, sf_dir)[1], "dst", "product", 7).select("kind", "src_type", "src_id")


EXTERNAL = "SELECT c_nationkey AS image_id, c_custkey AS ordinal, c_mktsegment AS namespace, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS value FROM customer"


def _external(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("namespace"), value.alias("value"), F.lit(None).cast("string").alias("version"))


@query(
    f"SELECT image_id, ordinal, namespace, value, CASE WHEN value = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY image_id, namespace ORDER BY value = '', ordinal) > 1 THEN 'duplicate' END AS reason FROM ({EXTERNAL})"
)
def external_id_attach(spark, sf_dir):
    return graph.attached(_external(spark, sf_dir), ["image_id"], "ordinal").drop("version")


@query(
    "WITH s AS (SELECT s_suppkey AS k, s_nationkey AS namespace, CAST(s_suppkey % 3 AS VARCHAR) AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'v' END AS version FROM supplier)"
    " SELECT a.k AS a, b.k AS b FROM s AS a JOIN s AS b ON a.namespace = b.namespace AND a.value = b.value AND a.version IS NOT DISTINCT FROM b.version WHERE a.k < b.k"
)
def external_id_equal(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("namespace"), (F.col("s_suppkey") % 3).cast("string").alias("value"), F.when(F.col("s_suppkey") % 2 == 0, "v").alias("version"))
    return s.alias("a").join(s.alias("b"), graph.same_external_id("a", "b")).where("a.k < b.k").select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))


@query("SELECT 'observation' AS entity_type, count(*) AS n FROM orders UNION ALL SELECT 'product', count(*) FROM part UNION ALL SELECT 'data-object', count(*) FROM lineitem")
def manifest_counts(spark, sf_dir):
    return graph.counts({"observation": table(spark, sf_dir, "orders"), "product": table(spark, sf_dir, "part"), "data-object": table(spark, sf_dir, "lineitem")})


@query("SELECT 'observation' AS entity_type FROM orders UNION ALL SELECT 'product' FROM part")
def entity_domains(spark, sf_dir):
    return graph.domains({"observation": table(spark, sf_dir, "orders"), "product": table(spark, sf_dir, "part")})


@query(
    "WITH a AS (SELECT p_partkey, ['x','y','band','time','depth'][p_size % 5 + 1] AS kind, p_size % 4 AS extent FROM part)"
    " SELECT p_partkey, kind, CASE WHEN kind = 'depth' THEN 'unknown kind' WHEN extent < 1 THEN 'extent below 1' WHEN kind = 'x' THEN 'duplicate kind' END AS problem,"
    " CASE WHEN kind = 'depth' OR extent < 1 OR kind = 'x' THEN 1 ELSE 2 END AS axes, CAST(64 AS BIGINT) AS x_extent FROM a"
)
def axis_validation(spark, sf_dir):
    axes = F.array(F.struct(F.lit("x").alias("kind"), F.lit(64).cast("bigint").alias("extent")))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("x", "y", "band", "time", "depth"))), F.col("p_size") % 5 + 1)
    extent = (F.col("p_size") % 4).cast("bigint")
    more = graph.with_axis(axes, kind, extent)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), graph.axis_problem(axes, kind, extent).alias("problem"), F.size(more).alias("axes"), graph.axis(more, F.lit("x"))["extent"].alias("x_extent"))


@query(
    "WITH r AS (SELECT o_custkey, '{\"kind\":\"produces\",\"source\":{\"entity\":\"observation\",\"id\":' || CAST(o_orderkey AS VARCHAR) || '},\"target\":{\"entity\":\"data-object\",\"id\":' || CAST(o_orderkey * 10 AS VARCHAR) || '}}' AS j, o_orderkey FROM orders)"
    " SELECT o_custkey AS scene_id, '{\"data_objects\":[],\"metadata\":{\"version\":1},\"provenance_relations\":[],\"relationships\":[' || string_agg(j, ',' ORDER BY o_orderkey) || ']}' AS json FROM r GROUP BY ALL"
)
def manifest_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    relations = o.select(F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("ordinal"), F.lit("observation").alias("src_type"), F.col("o_orderkey").alias("src_id"), F.lit("produces").alias("kind"), F.lit("data-object").alias("dst_type"), (F.col("o_orderkey") * 10).alias("dst_id"))
    provenance = spark.createDataFrame([], "scene_id bigint, ordinal bigint, process_id bigint, kind string, entity_type string, entity_id bigint")
    objects = spark.createDataFrame([], "scene_id bigint, ordinal bigint, axes array<struct<kind:string,extent:bigint>>")
    return graph.manifest(relations, provenance, objects).select("scene_id", F.to_json("manifest").alias("json"))


# Geometry: angles and places are made from suppliers' keys

ANGLES = "SELECT s_suppkey, radians(s_suppkey % 170 - 85) AS roll, radians(s_suppkey * 3 % 160 - 80) AS pitch, radians(s_suppkey * 7 % 350 - 175) AS yaw, s_acctbal / 1000 AS a FROM supplier"
QUAT = (
    f"SELECT *, cos(roll/2)*cos(pitch/2)*cos(yaw/2) + sin(roll/2)*sin(pitch/2)*sin(yaw/2) AS w, sin(roll/2)*cos(pitch/2)*cos(yaw/2) - cos(roll/2)*sin(pitch/2)*sin(yaw/2) AS x,"
    f" cos(roll/2)*sin(pitch/2)*cos(yaw/2) + sin(roll/2)*cos(pitch/2)*sin(yaw/2) AS y, cos(roll/2)*cos(pitch/2)*sin(yaw/2) - sin(roll/2)*sin(pitch/2)*cos(yaw/2) AS z FROM ({ANGLES})"
)


def _angles(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.radians(k % 170 - 85).alias("roll"), F.radians(k * 3 % 160 - 80).alias("pitch"), F.radians(k * 7 % 350 - 175).alias("yaw"), (F.col("s_acctbal") / 1000).alias("a"))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    """To nine digits; adding zero takes the sign off a negative zero."""
    return df.select(*keys, *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in df.columns if c not in keys))


def _posed(spark, sf_dir):
    rows = _angles(spark, sf_dir)
    q = geometry.from_euler(F.col("roll"), F.col("pitch"), F.col("yaw"))
    return rows.withColumns({f"q{n}": c for n, c in zip("wxyz", q, strict=True)}), tuple(F.col(f"q{n}") for n in "wxyz")


@query(f"SELECT s_suppkey, round(w, 9) + 0.0 AS w, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, round(z, 9) + 0.0 AS z, round(roll, 9) + 0.0 AS roll, round(pitch, 9) + 0.0 AS pitch, round(yaw, 9) + 0.0 AS yaw, round(2 * acos(least(1, abs(w))), 6) + 0.0 AS angle FROM ({QUAT})")
def quaternion_euler(spark, sf_dir):
    rows, q = _posed(spark, sf_dir)
    roll, pitch, yaw = geometry.to_euler(q)
    _, angle = geometry.to_axis_angle(q)
    out = rows.select("s_suppkey", *(c.alias(n) for c, n in zip(q, "wxyz", strict=True)), roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw"), F.round(angle, 6).alias("angle"))
    return _rounded(out, "s_suppkey")


R = ["1 - 2*(y*y + z*z)", "2*(x*y - w*z)", "2*(x*z + w*y)", "2*(x*y + w*z)", "1 - 2*(x*x + z*z)", "2*(y*z - w*x)", "2*(x*z - w*y)", "2*(y*z + w*x)", "1 - 2*(x*x + y*y)"]
RT = [*R[0:3], "a", *R[3:6], "2.0", *R[6:9], "3.0"]
K = ["700.0", "0.0", "8.0", "0.0", "715.0", "9.0", "0.0", "0.0", "1.0"]
P = [" + ".join(f"{K[r * 3 + m]} * ({RT[m * 4 + c]})" for m in range(3)) for r in range(3) for c in range(4)]


@query(f"SELECT s_suppkey, {', '.join(f'round({e}, 9) + 0.0 AS p{i}' for i, e in enumerate(P))} FROM ({QUAT})")
def camera_matrices(spark, sf_dir):
    rows, q = _posed(spark, sf_dir)
    k = geometry.intrinsic_matrix(F.lit(700.0), F.lit(715.0), F.lit(8.0), F.lit(9.0))
    p = geometry.projection_matrix(k, geometry.extrinsic_matrix((q, (F.col("a"), F.lit(2.0), F.lit(3.0)))))
    return _rounded(rows.select("s_suppkey", *(c.alias(f"p{i}") for i, c in enumerate(p))), "s_suppkey")


ACT = [f"({R[i * 3]}) * 1.0 + ({R[i * 3 + 1]}) * (-2.0) + ({R[i * 3 + 2]}) * a" for i in range(3)]


@query(
    f"SELECT s_suppkey, round({ACT[0]} + a, 9) + 0.0 AS x, round({ACT[1]} + 2.0, 9) + 0.0 AS y, round({ACT[2]} + 3.0, 9) + 0.0 AS z,"
    " CAST(1 AS DOUBLE) AS back_x, CAST(-2 AS DOUBLE) AS back_y, round(a, 9) + 0.0 AS back_z FROM (" + QUAT + ")"
)
def pose_act_compose(spark, sf_dir):
    """A pose, and its inverse after it."""
    rows, q = _posed(spark, sf_dir)
    pose = (q, (F.col("a"), F.lit(2.0), F.lit(3.0)))
    point = (F.lit(1.0), F.lit(-2.0), F.col("a"))
    there = geometry.act(pose, point)
    back = geometry.act(geometry.compose(geometry.invert(pose), pose), point)
    return _rounded(rows.select("s_suppkey", *(c.alias(n) for c, n in zip(there, "xyz", strict=True)), *(c.alias(f"back_{n}") for c, n in zip(back, "xyz", strict=True))), "s_suppkey")


@query("SELECT event_id, round(1.0 + value * 0.5, 9) + 0.0 AS x, round(2.0 - value * 0.25, 9) + 0.0 AS y, CAST(user_id AS DOUBLE) AS z, round(cos(value * 0.005), 9) + 0.0 AS w, round(sin(value * 0.005), 9) + 0.0 AS qz FROM events")
def state_propagate(spark, sf_dir):
    """Half a second of straight motion while turning about z."""
    pose = (geometry.identity()[0], (F.lit(1.0), F.lit(2.0), F.col("user_id").cast("double")))
    q, t = geometry.propagate(pose, (F.col("value"), F.col("value") * -0.5, F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.col("value") * 0.02), F.lit(0.5))
    return _rounded(table(spark, sf_dir, "events").select("event_id", t[0].alias("x"), t[1].alias("y"), t[2].alias("z"), q[0].alias("w"), q[3].alias("qz")), "event_id")


TWIST = "SELECT s_suppkey, s_acctbal / 1000 AS a, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE (s_suppkey % 7 + 1) / 10.0 END AS b FROM supplier"


@query(
    "SELECT s_suppkey, CASE WHEN b > 0 THEN round((b*a + 0.1) / (b*b + 0.25), 9) + 0.0 END AS pitch, CASE WHEN b > 0 THEN round(b / sqrt(b*b + 0.25), 9) + 0.0 END AS dx, CASE WHEN b > 0 THEN round(-0.5 * a / (b*b + 0.25) + b * 0.2 / (b*b + 0.25) * 0 + 0.0, 9) + 0.0 END AS pz"
    f" FROM ({TWIST})"
)
def screw_pitch_axis(spark, sf_dir):
    """Twists (a, 0.2, 0) and (b, 0.5, 0), or no rotation."""
    a = (F.col("s_acctbal") / 1000).alias("a")
    b = F.when(F.col("s_suppkey") % 5 == 0, F.lit(0.0)).otherwise((F.col("s_suppkey") % 7 + 1) / 10.0)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", a, b.alias("b"))
    linear, angular = (F.col("a"), F.lit(0.2), F.lit(0.0)), (F.col("b"), F.when(F.col("b") > 0, F.lit(0.5)).otherwise(0.0), F.lit(0.0))
    direction, point, pitch = geometry.screw_axis(linear, angular)
    return _rounded(rows.select("s_suppkey", pitch.alias("pitch"), direction[0].alias("dx"), (point[2] - F.col("b") * 0.2 / (F.col("b") * F.col("b") + 0.25)).alias("pz")), "s_suppkey")


@query("SELECT s_suppkey, CAST(0 AS DOUBLE) AS error, CAST(0 AS DOUBLE) AS half_error FROM supplier")
def pose_exp_log(spark, sf_dir):
    """exp(log(pose)) is the pose, and half of the way twice is the whole way."""
    rows, q = _posed(spark, sf_dir)
    pose = (q, (F.col("a"), F.lit(2.0), F.lit(3.0)))
    point = (F.lit(1.0), F.lit(-2.0), F.lit(0.5))
    # Each step's results are columns, so expressions stay small.
    rows, twist = geometry.settled(rows, "log", *geometry.log(pose))
    rows, again = geometry.settled(rows, "again", *geometry.exp(*twist))
    rows, half = geometry.settled(rows, "half", *geometry.exp(geometry.scale(twist[0], 0.5), geometry.scale(twist[1], 0.5)))
    rows, twice = geometry.settled(rows, "twice", *geometry.compose(half, half))
    far = lambda p: sum(F.abs(x - y) for x, y in zip(geometry.act(p, point), geometry.act(pose, point), strict=True))
    return rows.select("s_suppkey", (F.round(far(again), 7) + 0.0).alias("error"), (F.round(far(twice), 7) + 0.0).alias("half_error"))


# Files and codecs

CODECS = ("LZW", "PackBits", "Deflate", "Zstd", "Zlib")


@query("SELECT codec, count(*) AS texts, CAST(0 AS BIGINT) AS wrong, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents, (VALUES ('LZW'), ('PackBits'), ('Deflate'), ('Zstd'), ('Zlib')) AS v(codec) GROUP BY codec")
def codec_roundtrip(spark, sf_dir):
    found = files.codec_check(views.spread(table(spark, sf_dir, "documents")), "doc_id", "text", CODECS)
    return found.groupBy("codec").agg(F.count("*").alias("texts"), F.sum((~F.col("same")).cast("bigint")).alias("wrong"), F.sum("n_bytes").alias("n_bytes"))


Q_STATS = f"SELECT vec_id, x // 16 % 2 AS tile_col, CAST(min(q) AS DOUBLE) AS min_value, CAST(max(q) AS DOUBLE) AS max_value, round(avg(q), 9) AS mean_value, count(*) AS n FROM ({SAMPLES8}) GROUP BY ALL"


def _through_files(spark, sf_dir, kind, **options):
    """Embeddings as images of 32 by 2 samples, written and read back."""
    rows = views.samples8(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("x", "q"))).alias("s")).select("vec_id", F.col("s.q").alias("samples"))
    pixels = files.to_pixels(files.to_files(rows, "vec_id", 32, 16, 16, kind=kind, **options), "vec_id", kind)
    found = stats.channel_stats(stats.tiled(pixels, F.lit(16), F.lit(16)), ["vec_id", "tile_col"])
    return found.withColumn("mean_value", F.round("mean_value", 9))


@query(Q_STATS)
def tiff_roundtrip(spark, sf_dir):
    return _through_files(spark, sf_dir, "tiff", compression="LZW", predictor=2)


@query(Q_STATS)
def chunked_roundtrip(spark, sf_dir):
    return _through_files(spark, sf_dir, "chunked", compression="zstd")


@query(Q_STATS)
def isis_roundtrip(spark, sf_dir):
    return _through_files(spark, sf_dir, "isis", compression="None")


@query(Q_STATS)
def pds4_roundtrip(spark, sf_dir):
    return _through_files(spark, sf_dir, "pds4", compression="None")


@query(Q_STATS)
def raw_roundtrip(spark, sf_dir):
    return _through_files(spark, sf_dir, "raw", compression="None")


# Names from command lines and other programs

SPELLED = "['u8','Byte','uint16','I16','float','DOUBLE','complex'][p_size % 7 + 1]"
PACKED = "['zip','LZW','packbits','Deflate','none','jpg','brotli'][p_size % 7 + 1]"


@query(
    f"SELECT p_partkey, CASE lower({SPELLED}) WHEN 'u8' THEN 'UInt8' WHEN 'byte' THEN 'UInt8' WHEN 'uint16' THEN 'UInt16' WHEN 'i16' THEN 'Int16' WHEN 'float' THEN 'Float32' WHEN 'double' THEN 'Float64' END AS pixel_type,"
    f" CASE lower({PACKED}) WHEN 'zip' THEN 'Deflate' WHEN 'lzw' THEN 'LZW' WHEN 'packbits' THEN 'PackBits' WHEN 'deflate' THEN 'Deflate' WHEN 'none' THEN 'None' WHEN 'jpg' THEN 'Jpeg' END AS compression FROM part"
)
def parsed_names(spark, sf_dir):
    pick = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), F.col("p_size") % 7 + 1)
    kind, codec = pick("u8", "Byte", "uint16", "I16", "float", "DOUBLE", "complex"), pick("zip", "LZW", "packbits", "Deflate", "none", "jpg", "brotli")
    return table(spark, sf_dir, "part").select("p_partkey", samples.parse_pixel_type(kind, strict=False).alias("pixel_type"), samples.parse_compression(codec, strict=False).alias("compression"))


@query("SELECT n_nationkey, 'unspecified' AS kind, CAST(n_regionkey AS BIGINT) AS source_image, n_name AS tag FROM nation")
def geometry_fields(spark, sf_dir):
    """Scene geometry to fields and back."""
    f = fields.geometry_fields(F.lit("unspecified"), F.col("n_regionkey"), F.create_map(F.lit("tag"), F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", fields.geometry(f).alias("g")).select("n_nationkey", "g.kind", "g.source_image", F.try_element_at(F.col("g.parameters"), F.lit("tag")).alias("tag"))


@query("SELECT c_custkey, c_name AS model, CAST(c_acctbal AS DOUBLE) AS fx, CAST(c_nationkey AS DOUBLE) AS qw, 'x' AS timestamp FROM customer")
def camera_roundtrip(spark, sf_dir):
    """A typed camera to fields and back."""
    number = lambda c: F.lit(c).cast("double")
    made = F.struct(
        F.col("c_name").alias("model"), F.col("c_acctbal").alias("fx"), number(2).alias("fy"), number(3).alias("cx"), number(4).alias("cy"),
        F.struct(F.col("c_nationkey").cast("double").alias("w"), number(0).alias("x"), number(0).alias("y"), number(1).alias("z")).alias("rotation"), F.struct(number(1).alias("x"), number(2).alias("y"), number(3).alias("z")).alias("position"),
        F.lit("x").alias("timestamp"), F.struct(F.lit("pinhole").alias("kind"), F.create_map(F.lit("k1"), number(0.5)).alias("parameters")).alias("lens"),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", fields.camera_fields(made).alias("f")).select("c_custkey", fields.camera(F.col("f")).alias("c"))
    return rows.select("c_custkey", "c.model", "c.fx", F.col("c.rotation.w").alias("qw"), "c.timestamp")

"""Image-like views of the relational test tables, so that every operator has rows to work on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see; it goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        base = tempfile.gettempdir()
    path = f"{base.removeprefix('file://').removeprefix('file:').rstrip('/')}/tesserae-files-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes from so few and small files that most cores would idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < 4 * cores and len(df.inputFiles()) < cores  # files are listed only where they are few
    return df.repartition(cores) if few else df


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, w, h, t: parts as image descriptors with square tiles."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_size", (F.col("p_partkey") % 1000 + 64).alias("w"), (F.col("p_partkey") * 7 % 1000 + 64).alias("h"), ((F.col("p_size") % 8 + 1) * 16).cast("bigint").alias("t"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x, y, value: an embedding is an image one row high."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("x", "value")).select("vec_id", F.col("x").cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.col("value").cast("double").alias("value"))


def samples8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as 8-bit samples q."""
    return pixels(spark, sf_dir).withColumn("q", F.pmod(F.floor(F.col("value") * 100), F.lit(256)).cast("bigint"))


def field_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, fields: metadata maps in several domains."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id", "event_type",
        F.create_map(
            F.lit("image.spice.frame"), F.col("event_type"), F.lit("image.layers.dem"), F.col("user_id").cast("string"),
            F.lit("image.provenance.software"), F.coalesce(k, F.lit("")), F.lit("other.key"), F.lit("1"),
        ).alias("fields"),
    )


def scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities, relationships, provenance: orders are observations, line items data objects, parts products, suppliers processes.

    Some line items point at orders and parts that do not exist.
    """
    orders, items, parts, suppliers = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part", "supplier"))
    zero = F.lit(0).cast("bigint").alias("scene_id")
    item_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    entity = lambda df, kind, key: df.select(zero, F.lit(kind).alias("entity_type"), F.col(key).cast("bigint").alias("entity_id") if isinstance(key, str) else key.alias("entity_id"))
    entities = entity(orders, "observation", "o_orderkey").unionByName(entity(items, "data-object", item_id)).unionByName(entity(parts, "product", "p_partkey")).unionByName(entity(suppliers, "process-record", "s_suppkey"))
    off = lambda key, every: F.when(F.col(key) % every == 0, -F.col(key)).otherwise(F.col(key)).cast("bigint")
    produced = items.select(zero, (item_id * 2).alias("ordinal"), F.lit("observation").alias("src_type"), off("l_orderkey", 11).alias("src_id"), F.lit("produces").alias("kind"), F.lit("data-object").alias("dst_type"), item_id.alias("dst_id"))
    kind = F.when(F.col("l_linenumber") == 7, "produces").otherwise("derived-from")
    derived = items.select(zero, (item_id * 2 + 1).alias("ordinal"), F.lit("data-object").alias("src_type"), item_id.alias("src_id"), kind.alias("kind"), F.lit("product").alias("dst_type"), off("l_partkey", 13).alias("dst_id"))
    provenance = items.select(zero, item_id.alias("ordinal"), off("l_suppkey", 17).alias("process_id"), F.when(F.col("l_linenumber") % 2 == 0, "used").otherwise("generated").alias("kind"), F.lit("product").alias("entity_type"), F.col("l_partkey").cast("bigint").alias("entity_id"))
    return entities, produced.unionByName(derived), provenance

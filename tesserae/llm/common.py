"""What the operators of this subpackage share: tables, shared storage, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.views import spread

T = TypeVar("T")

# Characters that separate words: space, and U+0009 to U+000D.
WORD_BREAKS = " \t\n\x0b\x0c\r"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bounded(df: DataFrame) -> DataFrame:
    """df, with this session's Arrow batches bounded by bytes, unless a bound has been set: ten thousand long texts must not meet in one.

    Batches are made when a result is read, so the setting has to outlive the call.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":  # what Spark takes if nothing is set
        conf.set(key, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. One is made only on a single machine, and only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        found = tempfile.mkdtemp(prefix="tesserae-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. It is deleted when the application ends: results that are read later lie there."""
    path = f"{shared_dir(spark).rstrip('/')}/tesserae-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place.getParent())
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and any executor can read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made and that nothing reads again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


# A key with more than one part in so many of all rows is split; so at most this many keys are.
PARTS = 1024


def skewed_join(rows: DataFrame, lookup: DataFrame, key: str, by: Column, total: int, n: str = "n") -> DataFrame:
    """rows joined to lookup by key. lookup has few rows for each key and says how many of rows hold it (column n, which goes).

    Keys that hold more than their share of all rows are split by a hash of the column by, and their lookup rows are
    repeated for each split. There are at most PARTS such keys, so telling which they are is a broadcast of bounded
    size, and their repeats are at most twice as many for each of their lookup rows.
    """
    share = max(32, total // PARTS)
    times = F.when(F.col(n) > share, F.ceil(F.col(n) / share)).otherwise(1).cast("int")
    hot = lookup.where(F.col(n) > share).select(F.col(key).alias("_key"), times.alias("_times")).distinct()
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("_times")), F.lit(0)).cast("int")
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_salt", salt).drop("_key", "_times")
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), times - 1))).drop(n)
    return left.join(right, [key, "_salt"]).drop("_salt")


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What a worker process keeps between tasks: one thing at a time, so operators don't add up their tables."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Gives up what an operator before has kept in this worker process."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def components(links: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    links: columns a, b (long, not null). Returns node, root: the smallest node reachable.
    Every step is an aggregation and a join on node keys, split where a node has many edges; a step's edges are at
    most as many as before, and the steps grow with the logarithm of the longest path. Nothing but two sums reaches
    the driver.
    """
    shared_dir(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, n = mark, mark[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = skewed_join(both, low, "u", F.col("v"), 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        kept = skewed_join(large, low, "u", F.col("v"), n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

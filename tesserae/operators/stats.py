"""Statistics of tiles by channel, histograms, and summaries of repeated timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import grid

BINS = 64


def tiled(pixels: DataFrame, tile_w: Column, tile_h: Column) -> DataFrame:
    """pixels (x, y, ...) with the tile that each lies in."""
    return pixels.withColumn("_t", grid.tile_of(F.col("x"), F.col("y"), tile_w, tile_h)).withColumns({"tile_col": F.col("_t.tile_col"), "tile_row": F.col("_t.tile_row")}).drop("_t")


def finite(value: Column) -> Column:
    """False for null, NaN and infinite samples: they take no part in statistics."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def channel_stats(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """min_value, max_value, mean_value, n by keys, of finite samples: one shuffle of partial aggregates."""
    v = F.col(value).cast("double")
    return pixels.where(finite(v)).groupBy(*keys).agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.count(v).alias("n"))


def bin_of(value: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """Linear bins; all in bin 0 where the range is empty."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(high > low, F.floor(share * (bins - 1))).otherwise(F.lit(0)).cast("int")


def bin_label(b: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    return (low + (high - low) * (b + 0.5) / bins).cast("bigint")


def histogram(pixels: DataFrame, keys: list[str], value: str = "value", bins: int = BINS) -> DataFrame:
    """keys, bin, label, n, of finite samples. Ranges are aggregated first and joined back on the keys, so nothing is collected."""
    v = F.col(value).cast("double")
    pixels = pixels.where(finite(v))
    ranges = pixels.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    counted = pixels.join(ranges, keys).withColumn("bin", bin_of(v, F.col("_lo"), F.col("_hi"), bins)).groupBy(*keys, "bin", "_lo", "_hi").agg(F.count("*").alias("n"))
    return counted.withColumn("label", bin_label(F.col("bin"), F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")


def array_histogram(tiles: DataFrame, keys: list[str], values: str, bins: int = BINS) -> DataFrame:
    """The same where a row holds all samples of a tile (an array): its range is known there, so no join is needed."""
    rows = tiles.select(*keys, F.filter(F.transform(values, lambda x: x.cast("double")), finite).alias("_v"))
    rows = rows.withColumns({"_lo": F.array_min("_v"), "_hi": F.array_max("_v")})
    binned = rows.select(*keys, "_lo", "_hi", F.explode("_v").alias("_x")).withColumn("bin", bin_of(F.col("_x"), F.col("_lo"), F.col("_hi"), bins))
    counted = binned.groupBy(*keys, "bin", "_lo", "_hi").agg(F.count("*").alias("n"))
    return counted.withColumn("label", bin_label(F.col("bin"), F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")


def timing_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median_ms (of even counts the larger middle one), min_ms, max_ms of repeats. State grows with distinct values, not with rows."""
    middle = F.expr(f"percentile_disc({0.5 + 1e-10}) WITHIN GROUP (ORDER BY `{value}`)")
    return rows.groupBy(*keys).agg(middle.alias("median_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))

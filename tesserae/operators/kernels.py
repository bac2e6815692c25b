"""Sample kernels that are window functions or joins: predictors, offsets and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predictor_apply(pixels: DataFrame, row_keys: list[str], order: str, value: str, bits: int | Column) -> DataFrame:
    """residual: each sample less the one before in its row and channel, wrapping at 2 ** bits."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*row_keys).orderBy(order)), F.lit(0))
    return pixels.withColumn("residual", F.pmod(F.col(value).cast("bigint") - before, _modulus(bits)))


def predictor_undo(residuals: DataFrame, row_keys: list[str], order: str, value: str, bits: int | Column) -> DataFrame:
    """sample: running sum in each row and channel, wrapping at 2 ** bits."""
    total = F.sum(F.col(value).cast("bigint")).over(Window.partitionBy(*row_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return residuals.withColumn("sample", F.pmod(total, _modulus(bits)))


def _modulus(bits: int | Column) -> Column:
    return F.lit(1 << bits) if isinstance(bits, int) else F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)


def offsets(rows: DataFrame, order: str, size: str, keys: list[str], prefix: int = 0) -> DataFrame:
    """byte_offset: prefix and the sizes of all rows before, within keys (a file)."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("byte_offset", F.lit(prefix) + F.coalesce(F.sum(F.col(size).cast("bigint")).over(before), F.lit(0)))


def downsample_nearest(pixels: DataFrame, sizes: DataFrame, out_w: int, out_h: int, key: str) -> DataFrame:
    """key, ox, oy, value: output pixel o takes source pixel floor(o * size / out).

    sizes: key, width, height. An output grid of fixed size is made for each image and joined on source places.
    """
    cells = F.explode(F.sequence(F.lit(0), F.lit(out_w * out_h - 1))).alias("o")
    place = sizes.select(key, "width", "height", cells).select(
        key, (F.col("o") % out_w).alias("ox"), F.floor(F.col("o") / out_w).alias("oy"), "width", "height"
    )
    source = place.select(key, "ox", "oy", F.floor(F.col("ox") * F.col("width") / out_w).alias("x"), F.floor(F.col("oy") * F.col("height") / out_h).alias("y"))
    return source.join(pixels, [key, "x", "y"]).drop("x", "y")

"""Structured Streaming over image files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.sources import datasource

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def new_images(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the images table; path is a local glob that all executors see."""
    datasource.register(spark)
    return spark.readStream.format("raster").load(path)


def new_images_anywhere(spark: SparkSession, path: str, kind: str = "tiff") -> DataFrame:
    """The same from any store that Spark reads, over its own file source; with the file's time as `arrived`."""
    files = spark.readStream.format("binaryFile").schema(BINARY).load(path)
    images = datasource._over(files, kind, schemas.IMAGES, "images")
    return images.withColumn("arrived", F.current_timestamp())


def arrivals_by_window(images: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Images and pixels by window of arrival and sample type; state older than `late` is dropped."""
    windows = images.withWatermark("arrived", late).groupBy(F.window("arrived", width), "pixel_type")
    return windows.agg(F.count("*").alias("images"), F.sum(F.col("width") * F.col("height")).alias("pixels"))

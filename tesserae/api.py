"""What a user of image files calls: open, inspect, make, copy, thumbnail. All of it returns or takes DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import __version__, schemas
from tesserae.errors import InvalidArgument, NotFound
from tesserae.functions import codecs, fields, grid, samples
from tesserae.operators import kernels, stats
from tesserae.sources import datasource, tiff
from tesserae.sources.ranged import Ranged, reachable

MAX_TILE_STEP = 16


def version() -> str:
    return __version__


def _raster(spark: SparkSession, path: str, kind: str, table: str) -> DataFrame:
    datasource.register(spark)
    return spark.read.format("raster").option("container", kind).option("table", table).load(path)


def read_images(spark: SparkSession, path: str, kind: str = "tiff") -> DataFrame:
    """The images table. Headers are read in ranges where tasks can open the path, else from whole files."""
    return _raster(spark, path, kind, "images") if reachable(path) else datasource.images_of(spark, path, kind)


def read_tiles(spark: SparkSession, path: str, kind: str = "tiff", image_index: int | None = None) -> DataFrame:
    """The tiles table, in no order; order by image_index and linear_index for tile order. Filters by tile reach the reader."""
    rows = _raster(spark, path, kind, "tiles") if reachable(path) else datasource.tiles_of(spark, path, kind)
    return rows if image_index is None else rows.where(F.col("image_index") == image_index)


def read_pixels(spark: SparkSession, path: str, kind: str = "tiff") -> DataFrame:
    return datasource.pixels(read_tiles(spark, path, kind))


def image_bytes(spark: SparkSession, path: str, image_index: int = 0, kind: str = "tiff") -> bytes:
    """All tiles of an image, one after the other in tile order, padding included: for images that fit the driver."""
    return b"".join(bytes(r.data) for r in read_tiles(spark, path, kind, image_index).orderBy("linear_index").select("data").toLocalIterator())


def size_bytes(path: str, token: str | None = None) -> int:
    with Ranged(path, token) as f:
        return f.size


def backends() -> list[str]:
    """Names of the data sources that are registered, and of the containers that they read."""
    return [*datasource.registered(), *datasource.KINDS]


def tile(spark: SparkSession, path: str, image_index: int, col: int, row: int, kind: str = "tiff"):
    """One tile as an array (height, width, channels)."""
    r = read_tiles(spark, path, kind, image_index).where((F.col("tile_col") == col) & (F.col("tile_row") == row)).first()
    if r is None:
        raise NotFound(f"tile {col}, {row} of image {image_index}")
    return codecs.to_array(bytes(r.data), r.tile_h, r.tile_w, r.channel_count, r.pixel_type)


def info(images: DataFrame) -> DataFrame:
    """path, image_index, json: size, type, layout and compression."""
    parts = ("width", "height", "pixel_type", "channel_count", "tile_w", "tile_h", "tile_cols", "tile_rows", "compression", "predictor", "is_bigtiff")
    return images.select("path", "image_index", F.to_json(F.struct(*parts)).alias("json"))


def tile_list(images: DataFrame) -> DataFrame:
    """path, image_index, tiles."""
    size = [F.col(c) for c in ("width", "height", "tile_w", "tile_h")]
    return images.select("path", "image_index", grid.tile_total(*size).alias("tiles"))


def metadata(images: DataFrame, namespace: str = fields.NAMESPACE) -> DataFrame:
    """path, image_index, json: typed camera and coordinate system, and all fields."""
    f = F.col("fields")
    return images.select("path", "image_index", F.to_json(F.struct(fields.camera(f, namespace).alias("camera"), fields.crs(f, namespace).alias("crs"), f.alias("fields"))).alias("json"))


def tile_statistics(pixels: DataFrame, tile_w: int, tile_h: int) -> tuple[DataFrame, DataFrame]:
    """Statistics and histograms by tile and channel, of samples inside the image."""
    rows = stats.tiled(pixels, F.lit(tile_w), F.lit(tile_h))
    keys = ["path", "image_index", "tile_row", "tile_col", "channel"]
    return stats.channel_stats(rows, keys), stats.histogram(rows, keys)


def thumbnail(pixels: DataFrame, images: DataFrame, width: int, height: int) -> DataFrame:
    """path, image_index, channel, ox, oy, value: nearest neighbours on a grid of width by height."""
    keyed = pixels.withColumn("key", F.struct("path", "image_index"))
    sizes = images.select(F.struct("path", "image_index").alias("key"), "width", "height")
    return kernels.downsample_nearest(keyed.drop("path", "image_index"), sizes, width, height, "key").select("key.*", "channel", "ox", "oy", "value")


def write_thumbnail(spark: SparkSession, path: str, target: str, width: int, height: int, kind: str = "tiff") -> None:
    """Image 0 of a file, width by height, as a file of one tile."""
    images = read_images(spark, path, kind).where("image_index = 0")
    found = thumbnail(read_pixels(spark, path, kind).where("image_index = 0"), images, width, height)
    samples_ = F.transform(F.array_sort(F.collect_list(F.struct("oy", "ox", "channel", "value"))), lambda s: s["value"])
    whole = found.groupBy("path", "image_index").agg(samples_.alias("samples")).join(images.select("path", "image_index", "pixel_type", "channel_count"), ["path", "image_index"])
    zero = F.lit(0).cast("bigint")
    write(
        whole.select(
            F.lit(target).alias("path"), "image_index", F.lit(0).alias("level"), zero.alias("tile_col"), zero.alias("tile_row"), zero.alias("linear_index"), zero.alias("x"), zero.alias("y"),
            F.lit(width).cast("bigint").alias("tile_w"), F.lit(height).cast("bigint").alias("tile_h"), "pixel_type", "channel_count", codecs.packed("samples", "pixel_type").alias("data"),
        )
    )


def parse_size(text: str) -> tuple[int, int]:
    found = re.fullmatch(r"(\d+)[xX](\d+)", text.strip())
    if not found or not int(found[1]) or not int(found[2]):
        raise InvalidArgument(f"size {text}: WIDTHxHEIGHT")
    return int(found[1]), int(found[2])


def _checked(tile: int, pixel_type: str, channels: int) -> None:
    if tile % MAX_TILE_STEP or tile < MAX_TILE_STEP:
        raise InvalidArgument(f"tiles are multiples of {MAX_TILE_STEP}")
    if pixel_type not in samples.TYPES or not 1 <= channels <= tiff.MAX_CHANNELS:
        raise InvalidArgument("sample type or channels")


def constant_image(spark: SparkSession, path: str, width: int, height: int, value: float, pixel_type: str = "UInt8", channels: int = 1, tile: int = 64) -> DataFrame:
    """Tiles of one value, ready for write()."""
    _checked(tile, pixel_type, channels)
    t = F.lit(tile).cast("bigint")
    cells = spark.range(1).select(F.explode(grid.grid(F.lit(width).cast("bigint"), F.lit(height).cast("bigint"), t, t)).alias("g")).select("g.*")
    data = codecs.constant(value, tile * tile * channels, pixel_type)
    return cells.select(
        F.lit(path).alias("path"), F.lit(0).alias("image_index"), F.lit(0).alias("level"), "tile_col", "tile_row", "linear_index", (F.col("tile_col") * tile).alias("x"), (F.col("tile_row") * tile).alias("y"),
        t.alias("tile_w"), t.alias("tile_h"), F.lit(pixel_type).alias("pixel_type"), F.lit(channels).alias("channel_count"), F.lit(0).cast("bigint").alias("byte_offset"), F.lit(len(data)).cast("bigint").alias("byte_count"), F.lit(data).alias("data"),
    )


def write(tiles: DataFrame, **options: str) -> None:
    """Files of tiles: options container, width, height, compression, predictor, namespace, fields."""
    datasource.write_tiles(tiles, **options)


def copy(spark: SparkSession, path: str, target: str, **options: str) -> None:
    """The same images under another folder, with their fields."""
    datasource.copy(read_tiles(spark, path), target, **options)


class Sink:
    """One image that is written tile by tile and becomes a file when it is closed. Tiles that never came are zero.

    For images that fit the driver; larger ones are rows of a tiles table for write().
    """

    def __init__(self, spark: SparkSession, path: str, width: int, height: int, pixel_type: str = "UInt8", channels: int = 1, tile: int = 64, fields: dict[str, str] | None = None, **options: str):
        self.spark, self.path, self.options = spark, path, options | ({"fields": json.dumps(fields)} if fields else {})
        _checked(tile, pixel_type, channels)
        self.canvas: tiff.Canvas | None = tiff.Canvas(tiff.Image(width, height, pixel_type, channels, tile, tile))

    def _open(self) -> tiff.Canvas:
        if self.canvas is None:
            raise InvalidArgument("the image is closed")
        return self.canvas

    def write_tile(self, col: int, row: int, data: bytes | str) -> None:
        """data: the tile's samples, or their hexadecimal digits."""
        self._open().write_tile(col, row, bytes.fromhex(data) if isinstance(data, str) else data)

    def fill(self, value: float) -> None:
        """All tiles, of one value."""
        canvas = self._open()
        data = codecs.constant(value, canvas.size // samples.TYPES[canvas.image.pixel_type][0], canvas.image.pixel_type)
        for number in range(len(canvas.tiles)):
            canvas.write_tile(number % canvas.cols, number // canvas.cols, data)

    def info(self) -> dict[str, object]:
        open_ = self.canvas is not None
        return {"path": self.path, "tiles": len(self.canvas.tiles) if open_ else 0, "written": len(self.canvas.written) if open_ else 0, "open": open_, **self.options}

    def close(self) -> None:
        """Writes the file; what goes wrong is raised. A second call does nothing."""
        if self.canvas is None:
            return
        canvas, self.canvas = self.canvas, None
        i = canvas.image
        schema = self.spark.createDataFrame([], schemas.TILES).schema
        place = lambda n: {"tile_col": n % canvas.cols, "tile_row": n // canvas.cols, "linear_index": n, "x": n % canvas.cols * i.tile_w, "y": n // canvas.cols * i.tile_h}
        same = {"path": self.path, "image_index": 0, "level": 0, "tile_w": i.tile_w, "tile_h": i.tile_h, "pixel_type": i.pixel_type, "channel_count": i.channels, "width": i.width, "height": i.height}
        rows = [same | place(n) | {"data": data} for n, data in enumerate(canvas.tiles)]
        write(self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema), **self.options)


def describe(**options: object) -> str:
    """The image that options ask for, as JSON."""
    return json.dumps(options, sort_keys=True)

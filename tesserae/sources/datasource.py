"""Spark data sources over image files.

spark.read.format("raster").option("table", "images" | "tiles" | "tags").load(paths): paths are on file systems that
tasks open themselves (a mount that all executors share, s3, gs, hdfs; globs allowed) or http(s) URLs, separated by
commas. Planning lists files and opens none: a file of n bytes is n / `partition_bytes` partitions, and each task parses
the header and takes its share of the tiles. Equality filters on path, image_index, tile_col, tile_row and linear_index
are pushed down, so only these tiles' bytes are read.

df.write.format("raster").mode("append"): rows of TILES become files, one for each path; see RasterWriter.

Files in stores that only Spark reads go through images_of() and tiles_of(), over Spark's own binaryFile source.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from tesserae import schemas
from tesserae.errors import InvalidArgument, NotFound
from tesserae.sources import containers, tiff
from tesserae.sources.ranged import Ranged, found, place

TAGS = "path string, image_index int, tag int, values array<decimal(20,0)>"
TABLES = {"images": schemas.IMAGES, "tiles": schemas.TILES, "tags": TAGS}
KINDS = ("tiff", *containers.PARSERS)
PUSHED = ("image_index", "tile_col", "tile_row", "linear_index", "path")


def listed(path: str) -> list[tuple[str, int, int]]:
    out = found(path)
    if not out:
        raise NotFound(path)
    return out


def directories(read: tiff.ReadAt, kind: str) -> list:
    """Headers alone are read."""
    return tiff.images(read) if kind == "tiff" else containers.parse(kind, read(0, containers.MAX_LABEL + 8))


def image_row(path: str, index: int, image) -> tuple:
    if isinstance(image, tiff.Image):
        return (path, index, image.width, image.height, image.pixel_type, image.channels, None, image.tile_w, image.tile_h, image.cols, image.rows, image.compression, "horizontal" if image.predictor == 2 else "none", "little" if image.little else "big", image.big, image.fields)
    return (path, index, image.width, image.height, image.pixel_type, image.channels, None, image.tile_w, image.tile_h, image.cols, image.rows, image.compression, "none", "little", False, image.fields)


def tile_row(path: str, index: int, image, number: int, read: tiff.ReadAt, kind: str) -> tuple:
    """A row of TILES. An image's fields come with its first tile."""
    row, col = divmod(number, image.cols)
    if kind == "tiff":
        data, (w, h), place = tiff.read_tile(read, image, col, row), image.tile_size(row), image.ranges[number]
    else:
        data = containers.tile(kind, read, image, col, row)
        w, h, size = image.tile_w, image.tile_h, image.slot or image.tile_bytes
        place = (image.start + number * size, size)
    more = image.width, image.height, image.compression, getattr(image, "predictor", 1), image.fields if number == 0 else None
    return (path, index, 0, col, row, number, col * image.tile_w, row * image.tile_h, w, h, image.pixel_type, image.channels, *place, data, *more)


@dataclass
class Run(InputPartition):
    """One of `parts` shares of a file's tiles."""

    path: str
    part: int = 0
    parts: int = 1


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.filters = options, {}
        self.table, self.kind = options.get("table", "images"), options.get("container", "tiff")
        if self.table not in TABLES or self.kind not in KINDS:
            raise InvalidArgument(f"table {self.table} or container {self.kind}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.filters[f.attribute[0]] = f.value
            yield f  # Spark filters again, which is cheap beside reading

    def _open(self, path: str) -> Ranged:
        return Ranged(path, self.options.get("token"))

    def _wants(self, index: int, image, number: int) -> bool:
        place = {"image_index": index, "linear_index": number, "tile_col": number % image.cols, "tile_row": number // image.cols}
        return all(self.filters.get(k, v) == v for k, v in place.items())

    def partitions(self) -> list[Run]:
        one_tile = "linear_index" in self.filters or {"tile_col", "tile_row"} <= self.filters.keys()
        size = int(self.options.get("partition_bytes", 32 << 20))
        out = []
        for path, n, _ in listed(self.options["path"]):
            if self.filters.get("path", path) == path:
                parts = 1 if one_tile or self.table != "tiles" else max(1, -(-n // size))
                out += [Run(path, i, parts) for i in range(parts)]
        return out or [Run("")]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not partition.path:
            return
        with self._open(partition.path) as f:
            images = directories(f.read, self.kind)
            total, at = sum(i.cols * i.rows for i in images), 0
            for index, image in enumerate(images):
                if self.table == "images":
                    yield image_row(partition.path, index, image)
                elif self.table == "tags":
                    for number, values in getattr(image, "tags", {}).items():
                        yield partition.path, index, number, [Decimal(v) for v in values]
                else:
                    n = image.cols * image.rows
                    first, last = (max(0, min(n, total * p // partition.parts - at)) for p in (partition.part, partition.part + 1))
                    for number in range(first, last):
                        if self._wants(index, image, number):
                            yield tile_row(partition.path, index, image, number, f.read, self.kind)
                    at += n


class RasterStream(DataSourceStreamReader):
    """New files under a path. The offset is the last file seen, by time of modification and then by name, so a file
    counts as new wherever its name sorts; one that is put there with a time before the offset's is not seen."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def _files(self) -> list[tuple[int, str]]:
        return sorted((time, path) for path, _, time in found(self.options["path"]))

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return dict(zip(("time", "path"), files[-1], strict=True)) if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Run]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return [Run(path) for time, path in self._files() if after < (time, path) <= last]

    def read(self, partition: Run) -> Iterator[tuple]:
        yield from RasterReader(self.options | {"table": "images"}).read(partition)


@dataclass
class Written(WriterCommitMessage):
    """(temporary path, path) of a task's files."""

    moves: list[tuple[str, str]]


class RasterWriter(DataSourceWriter):
    """Writes files of tiles: rows of TILES that come grouped by path, and by image and tile within it.

    Options: container (tiff), compression, predictor, namespace, width, height, fields (a JSON object). What no option
    says comes from the rows: sizes, compression, predictor, and fields from an image's first tile. Each path is held by
    itself and goes to a name of its own attempt; commit moves these into place and abort deletes them, so a task that
    fails or runs twice leaves nothing behind. The folder must be one that all executors and the driver see.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options

    def _image(self, rows: list) -> tiff.Image:
        first = rows[0]
        of = lambda name, otherwise: self.options.get(name, getattr(first, name, None) or otherwise)
        width, height = int(of("width", max(r.x + r.tile_w for r in rows))), int(of("height", max(r.y + r.tile_h for r in rows)))
        fields = json.loads(self.options["fields"]) if "fields" in self.options else dict(getattr(first, "fields", None) or {})
        return tiff.Image(width, height, first.pixel_type, first.channel_count, first.tile_w, first.tile_h, of("compression", "None"), int(of("predictor", 1)), fields=fields)

    def _content(self, rows: list) -> bytes:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r.image_index, []).append(r)
        images, tiles = [], []
        for _, own in sorted(by.items()):
            own.sort(key=lambda r: r.linear_index)
            images.append(self._image(own))
            tiles.append([bytes(r.data) for r in own])
        kind = self.options.get("container", "tiff")
        if kind == "tiff":
            return tiff.write(images, tiles, self.options.get("namespace", "image"))
        if len(images) != 1:
            raise InvalidArgument(f"{kind} files hold one image")
        return containers.write(kind, containers.fields_of(images[0]), tiles[0])

    def write(self, rows: Iterator) -> Written:
        moves: list[tuple[str, str]] = []
        held: list = []

        def flush() -> None:
            if held:
                path = held[0].path
                moves.append((f"{path}.{uuid.uuid4().hex}.part", path))
                _put(moves[-1][0], self._content(held))
                held.clear()

        try:
            for r in rows:
                if held and held[0].path != r.path:
                    flush()
                held.append(r)
            flush()
        except BaseException:
            _drop(part for part, _ in moves)
            raise
        return Written(moves)

    def commit(self, messages: list) -> None:
        for m in messages:
            for part, path in m.moves if m else ():
                store, inside = place(path)
                store.move(place(part)[1], inside)

    def abort(self, messages: list) -> None:
        _drop(part for m in messages if m for part, _ in m.moves)


def _put(path: str, data: bytes) -> None:
    store, inside = place(path)
    with store.open_output_stream(inside) as f:
        f.write(data)


def _drop(paths) -> None:
    for path in paths:
        store, inside = place(path)
        try:
            store.delete_file(inside)
        except FileNotFoundError:
            continue


class Raster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "images")]

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))

    def streamReader(self, schema) -> RasterStream:
        return RasterStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(dict(self.options))


REGISTERED: dict[str, type[DataSource]] = {}


def register(spark: SparkSession, source: type[DataSource] = Raster) -> None:
    """Once for each name; another source under a taken name is refused."""
    if REGISTERED.setdefault(source.name(), source) is not source:
        raise InvalidArgument(f"source {source.name()} is registered")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def registered() -> list[str]:
    return sorted(REGISTERED)


def _over(files: DataFrame, kind: str, ddl: str, table: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromJson(described))
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = lambda at, n, d=data: d[at : at + n]
                for index, image in enumerate(directories(read, kind)):
                    rows = iter([image_row(path, index, image)]) if table == "images" else (tile_row(path, index, image, n, read, kind) for n in range(image.cols * image.rows))
                    for row in rows:  # a tile is a batch of its own: one may be large
                        yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    described = files.sparkSession.createDataFrame([], ddl).schema.jsonValue()
    return files.select("path", "content").mapInArrow(run, ddl)


def images_of(spark: SparkSession, path: str, kind: str = "tiff") -> DataFrame:
    """The images table of files in any store that Spark reads."""
    return _over(spark.read.format("binaryFile").load(path), kind, schemas.IMAGES, "images")


def tiles_of(spark: SparkSession, path: str, kind: str = "tiff") -> DataFrame:
    return _over(spark.read.format("binaryFile").load(path), kind, schemas.TILES, "tiles")


def pixels(tiles: DataFrame) -> DataFrame:
    """path, image_index, x, y, channel, value (double): samples inside the image; padding of edge tiles is left out."""
    from tesserae.functions import samples

    used = ["path", "image_index", "x", "y", "tile_w", "tile_h", "width", "height", "pixel_type", "channel_count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["path", "image_index", "x", "y", "channel", "value"]
        for batch in batches:
            for i, (path, index, x0, y0, w, h, width, height, kind, channels) in enumerate(zip(*(batch.column(c).to_pylist() for c in used), strict=True)):
                a = np.frombuffer(batch.column(len(used))[i].as_buffer(), samples.dtype(kind)).reshape(h, w, channels)
                a = a[: max(0, height - y0), : max(0, width - x0)]
                y, x, c = np.indices(a.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * a.size, pa.string()), pa.array(np.full(a.size, index), pa.int32()), pa.array(x.ravel() + x0), pa.array(y.ravel() + y0), pa.array(c.ravel(), pa.int32()), pa.array(a.ravel().astype(np.float64))], names
                )

    return tiles.select(*used, "data").mapInArrow(run, "path string, image_index int, x bigint, y bigint, channel int, value double")


def write_tiles(tiles: DataFrame, **options: str) -> None:
    """One file for each path; a file is one task's work, so its tiles meet in one partition. Columns that say nothing
    may be missing: sizes, compression, predictor and fields."""
    register(tiles.sparkSession)
    wanted = tiles.sparkSession.createDataFrame([], schemas.TILES).schema
    have = [F.col(f.name) if f.name in tiles.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    tiles.select(*have).repartition("path").sortWithinPartitions("path", "image_index", "linear_index").write.format("raster").mode("append").options(**options).save()


def copy(tiles: DataFrame, target: str, **options: str) -> None:
    """The same tiles, sizes and fields under another folder."""
    write_tiles(tiles.withColumn("path", F.concat(F.lit(target.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1))), **options)

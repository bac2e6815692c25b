"""Whole image files as binary columns: rows of samples to files and back, without a file system."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import codecs, samples
from tesserae.sources import containers, datasource, tiff


def _tiles(a: np.ndarray, tile_w: int, tile_h: int) -> list[bytes]:
    """Tiles of an array (height, width, channels), padded with zeros at the edges."""
    h, w, _ = a.shape
    padded = np.pad(a, ((0, -h % tile_h), (0, -w % tile_w), (0, 0)))
    return [np.ascontiguousarray(padded[y : y + tile_h, x : x + tile_w]).tobytes() for y in range(0, h, tile_h) for x in range(0, w, tile_w)]


def to_files(rows: DataFrame, key: str, width: int, tile_w: int, tile_h: int, pixel_type: str = "UInt8", compression: str = "LZW", predictor: int = 2, kind: str = "tiff") -> DataFrame:
    """key, content: an image file for each row of key and samples (array, row-major, one channel)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column(1).to_pylist():
                a = np.array(values).astype(samples.dtype(pixel_type)).reshape(-1, width, 1)
                if kind == "tiff":
                    image = tiff.Image(width, len(a), pixel_type, 1, tile_w, tile_h, compression, predictor)
                    out.append(tiff.write([image], [_tiles(a, tile_w, tile_h)]))
                else:
                    fields = {"imageWidth": width, "imageHeight": len(a), "samplesPerPixel": 1, "pixelType": pixel_type, "tileWidth": tile_w, "tileHeight": tile_h, "compression": compression}
                    out.append(containers.write(kind, {k: str(v) for k, v in fields.items()}, _tiles(a, tile_w, tile_h)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "content"])

    return rows.select(F.col(key).cast("bigint").alias(key), "samples").mapInArrow(run, f"{key} bigint, content binary")


def to_pixels(files: DataFrame, key: str, kind: str = "tiff") -> DataFrame:
    """key, x, y, channel, value (double) of image 0, without padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = lambda at, n, d=data: d[at : at + n]
                image = datasource.directories(read, kind)[0]
                for number in range(image.cols * image.rows):
                    row = datasource.tile_row("", 0, image, number, read, kind)
                    x0, y0, w, h, raw = row[6], row[7], row[8], row[9], row[14]
                    a = codecs.to_array(raw, h, w, image.channels, image.pixel_type)[: image.height - y0, : image.width - x0]
                    y, x, c = np.indices(a.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(a.size, k)), pa.array(x.ravel() + x0), pa.array(y.ravel() + y0), pa.array(c.ravel(), pa.int32()), pa.array(a.ravel().astype(np.float64))], [key, "x", "y", "channel", "value"]
                    )

    return files.select(key, "content").mapInArrow(run, f"{key} bigint, x bigint, y bigint, channel int, value double")


def codec_check(rows: DataFrame, key: str, data: str, names: tuple[str, ...]) -> DataFrame:
    """key, codec, same, n_bytes: whether decoding what was encoded gives it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for name in names:
                same, size = [], []
                for d in batch.column(1).to_pylist():
                    d = d or b""
                    same.append(codecs.DECODERS[name](codecs.ENCODERS[name](d), len(d)) == d if d else True)
                    size.append(len(d))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([name] * len(keys)), pa.array(same), pa.array(size, pa.int64())], ["key", "codec", "same", "n_bytes"])

    return rows.select(F.col(key).cast("bigint"), F.col(data).cast("binary")).mapInArrow(run, "key bigint, codec string, same boolean, n_bytes bigint")

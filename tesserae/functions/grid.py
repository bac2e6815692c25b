"""Tile grids as expressions. All arithmetic is in BIGINT; a layout without tiles (0) has an empty grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative numbers below 2 ** 53."""
    return F.floor(a / b).cast("bigint")


def untiled(tile_w: Column, tile_h: Column) -> Column:
    return (tile_w == 0) | (tile_h == 0)


def tiles_along(size: Column, tile: Column, level: Column | int = 0) -> Column:
    """Tiles along one side at a level, whose size is halved level times, rounding down."""
    shifted = F.call_function("shiftright", size.cast("bigint"), level if isinstance(level, Column) else F.lit(level))
    return F.when(tile == 0, F.lit(0).cast("bigint")).otherwise(_whole(shifted + tile - 1, tile))


def tile_total(width: Column, height: Column, tile_w: Column, tile_h: Column, level: Column | int = 0) -> Column:
    return tiles_along(width, tile_w, level) * tiles_along(height, tile_h, level)


def tile_of(x: Column, y: Column, tile_w: Column, tile_h: Column, level: Column | int = 0) -> Column:
    level = level if isinstance(level, Column) else F.lit(level)
    return F.struct(_whole(x, tile_w).alias("tile_col"), _whole(y, tile_h).alias("tile_row"), level.alias("level"))


def region_of(tile_col: Column, tile_row: Column, tile_w: Column, tile_h: Column) -> Column:
    """A tile's region; it has the full tile size at edges too."""
    return F.struct((tile_col * tile_w).alias("x"), (tile_row * tile_h).alias("y"), tile_w.alias("tile_w"), tile_h.alias("tile_h"))


def region_in(tile_col: Column, tile_row: Column, width: Column, height: Column, tile_w: Column, tile_h: Column) -> Column:
    """The same, but a tile out of the grid raises OUT_OF_RANGE."""
    inside = (tile_col >= 0) & (tile_row >= 0) & (tile_col < tiles_along(width, tile_w)) & (tile_row < tiles_along(height, tile_h))
    return F.when(inside, region_of(tile_col, tile_row, tile_w, tile_h)).otherwise(F.raise_error(F.lit("OUT_OF_RANGE: tile index")))


def grid(width: Column, height: Column, tile_w: Column, tile_h: Column, level: Column | int = 0) -> Column:
    """Array of (tile_col, tile_row, linear_index) of all tiles; to be exploded."""
    columns, rows = tiles_along(width, tile_w, level), tiles_along(height, tile_h, level)
    total = columns * rows
    each = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(total - 1, F.lit(0))), lambda i: F.struct((i % columns).alias("tile_col"), _whole(i, columns).alias("tile_row"), i.alias("linear_index")))
    return F.when(total > 0, each).otherwise(F.array().cast("array<struct<tile_col:bigint,tile_row:bigint,linear_index:bigint>>"))


def tile_bytes(tile_w: Column, tile_h: Column, channels: Column, sample_bytes: Column) -> Column:
    """Raises on overflow under ANSI arithmetic."""
    return tile_w.cast("bigint") * tile_h * channels * sample_bytes

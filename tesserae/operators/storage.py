"""Scenes as storage trees and back: a row for each child node, a flat map of fields in it.

A tree is rows of (scene_id, ordinal, fields): images in order, then a scene's own cameras and geometries, which
carry a marker of their type. TIFF files hold the images only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import fields as fields_
from tesserae.functions import samples

COMPRESSIONS = ("None", "LZW", "PackBits", "Deflate", "Jpeg")


def _marker(namespace: str) -> str:
    return f"{namespace}.scene.object_type"


def _raise(message: str, kind: str = "string") -> Column:
    return F.raise_error(F.lit(f"INVALID_ARGUMENT: {message}")).cast(kind)


def image_fields(namespace: str = fields_.NAMESPACE) -> Column:
    """Of a row of width, height, channel_count, pixel_type, compression, tile_w, tile_h, camera, crs, fields.

    1 to 512 channels; JPEG needs 8-bit samples; a ground sample distance is no field.
    """
    channels = F.when(F.col("channel_count").between(1, 512), F.col("channel_count").cast("string")).otherwise(_raise("samples per pixel"))
    kind = F.coalesce("compression", F.lit("None"))
    compression = F.when((kind == "Jpeg") & (F.col("pixel_type") != "UInt8"), _raise("JPEG needs 8-bit samples")).when(kind.isin(*COMPRESSIONS), kind).otherwise(_raise("compression"))
    pairs = {"imageWidth": F.col("width").cast("string"), "imageHeight": F.col("height").cast("string"), "samplesPerPixel": channels, "pixelType": F.col("pixel_type"), "compression": compression}
    pairs |= {"tileWidth": F.col("tile_w").cast("string"), "tileHeight": F.col("tile_h").cast("string")}
    flat = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    none = F.create_map().cast("map<string,string>")
    typed = [F.when(F.col(c).isNotNull(), make(F.col(c), namespace)).otherwise(none) for c, make in (("camera", fields_.camera_fields), ("crs", fields_.crs_fields))]
    return F.map_concat(flat, *typed, F.coalesce("fields", none))


def serialised(images: DataFrame, cameras: DataFrame | None = None, geometries: DataFrame | None = None, namespace: str = fields_.NAMESPACE) -> DataFrame:
    """scene_id, ordinal, fields: images (scene_id, id, ...), cameras (scene_id, id, camera) and geometries (scene_id, id, kind,
    source_image, parameters) as child nodes, numbered from 0 in this order."""
    marked = lambda kind, made: F.map_concat(F.create_map(F.lit(_marker(namespace)), F.lit(kind)), made)
    parts = [images.select("scene_id", F.lit(0).alias("_part"), "id", image_fields(namespace).alias("fields"))]
    if cameras is not None:
        parts.append(cameras.select("scene_id", F.lit(1).alias("_part"), "id", marked("camera", fields_.camera_fields(F.col("camera"), namespace)).alias("fields")))
    if geometries is not None:
        made = fields_.geometry_fields(F.col("kind"), F.col("source_image"), F.col("parameters"), namespace)
        parts.append(geometries.select("scene_id", F.lit(2).alias("_part"), "id", marked("geometry", made).alias("fields")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return children(rows, ["_part", "id"])


def children(rows: DataFrame, order: list[str]) -> DataFrame:
    """Child nodes of scenes, numbered in order."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("scene_id").orderBy(*order)) - 1).select("scene_id", "ordinal", "fields")


def object_type(namespace: str = fields_.NAMESPACE) -> Column:
    """Of a child node: image, camera or geometry; others raise."""
    kind = F.try_element_at("fields", F.lit(_marker(namespace)))
    return F.when(kind.isNull(), "image").when(kind.isin("camera", "geometry"), kind).otherwise(_raise("object type"))


def images(tree: DataFrame, namespace: str = fields_.NAMESPACE) -> DataFrame:
    """scene_id, id, width, height, channel_count, pixel_type, compression, tile_w, tile_h, camera, crs, fields.

    Fields keep all of the namespace but what a whole camera or coordinate system has taken; tile sizes come back too.
    """
    f = F.col("fields")
    number = lambda k: F.when(F.try_element_at(f, F.lit(k)).try_cast("bigint").isNotNull(), F.try_element_at(f, F.lit(k)).try_cast("bigint")).otherwise(_raise(k, "bigint"))
    optional = lambda k: F.try_element_at(f, F.lit(k)).try_cast("bigint")
    kind = F.try_element_at(f, F.lit("pixelType"))
    compression = F.coalesce(F.try_element_at(f, F.lit("compression")), F.lit("None"))
    rows = tree.where(object_type(namespace) == "image").withColumns({"camera": fields_.camera(f, namespace), "crs": fields_.crs(f, namespace)})
    owned = lambda k: (F.col("camera").isNotNull() & k.startswith(f"{namespace}.camera.")) | (F.col("crs").isNotNull() & k.startswith(f"{namespace}.crs."))
    return rows.select(
        "scene_id", (F.row_number().over(Window.partitionBy("scene_id").orderBy("ordinal")) - 1).alias("id"), number("imageWidth").alias("width"), number("imageHeight").alias("height"), number("samplesPerPixel").cast("int").alias("channel_count"),
        F.when(kind.isin(*samples.TYPES), kind).otherwise(_raise("pixelType")).alias("pixel_type"), F.when(compression.isin(*COMPRESSIONS), compression).otherwise(_raise("compression")).alias("compression"),
        optional("tileWidth").alias("tile_w"), optional("tileHeight").alias("tile_h"), "camera", "crs", F.map_filter(f, lambda k, _: k.startswith(f"{namespace}.") & ~owned(k)).alias("fields"),
    )


def cameras(tree: DataFrame, namespace: str = fields_.NAMESPACE) -> DataFrame:
    """scene_id, id, camera of a scene's own cameras; partial ones are passed over."""
    rows = tree.where(object_type(namespace) == "camera").select("scene_id", "ordinal", fields_.camera(F.col("fields"), namespace).alias("camera")).where("camera is not null")
    return rows.select("scene_id", (F.row_number().over(Window.partitionBy("scene_id").orderBy("ordinal")) - 1).alias("id"), "camera")


def geometries(tree: DataFrame, namespace: str = fields_.NAMESPACE) -> DataFrame:
    """scene_id, id, geometry of a scene's own geometries."""
    rows = tree.where(object_type(namespace) == "geometry").select("scene_id", "ordinal", fields_.geometry(F.col("fields"), namespace).alias("geometry")).where("geometry is not null")
    return rows.select("scene_id", (F.row_number().over(Window.partitionBy("scene_id").orderBy("ordinal")) - 1).alias("id"), "geometry")

"""Queries whose SQL computes formats, metadata and motions by itself: bytes, labels, trees, files that are written and scanned."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tesserae import api
from tesserae.errors import RasterError
from tesserae.functions import canonical, codecs, fields, geometry, payload, samples
from tesserae.operators import graph, kernels, stats, storage
from tesserae.plans import golden, views
from tesserae.plans.catalogue import BODY, ENTRIES, LAYOUTS, PIXELS, QUAT, SAMPLES8, TYPE_OF_SIZE, _pixel_type, _posed, _rounded, query
from tesserae.plans.views import table
from tesserae.sources import containers, datasource, tiff


def _le(n: str, size: int) -> str:
    """SQL: a number's bytes, the lowest first, as hexadecimal digits."""
    return "(" + " || ".join(f"printf('%02X', (CAST({n} AS BIGINT) >> {8 * i}) & 255)" for i in range(size)) + ")"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else _text(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS v({names})"


# Formats


@query(_values([(k, n, w, h, t, c, z, i, d) for k, n, w, h, t, c, z, i, d in golden.TILES], "container, name, width, height, pixel_type, channels, compression, tile, samples"))
def golden_files(spark, sf_dir):
    """Files made by hand: both byte orders, BigTIFF, strips, tiles, every codec of a TIFF, and all other containers."""
    files = spark.createDataFrame([(k, n, bytes.fromhex(d)) for (k, n), d in golden.FILES.items()], "container string, path string, content binary")
    out = None
    for kind in datasource.KINDS:
        tiles = datasource._over(files.where(F.col("container") == kind), kind, datasource.TABLES["tiles"], "tiles")
        rows = tiles.select(
            F.lit(kind).alias("container"), F.col("path").alias("name"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixel_type",
            F.col("channel_count").alias("channels"), "compression", F.col("linear_index").cast("int").alias("tile"), F.hex("data").alias("samples"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_STRIP = golden.FILES["tiff", "int16_strip"]
# What is wrong, the file, and the code of the error.
DAMAGED = [
    ("sound", _STRIP, "OK"),
    ("empty", "", "INVALID_ARGUMENT"),
    ("byte order", "5858" + _STRIP[4:], "INVALID_ARGUMENT"),
    ("magic", _STRIP[:4] + "2c00" + _STRIP[8:], "INVALID_ARGUMENT"),
    ("offset size", golden.FILES["tiff", "big_tiff_tiles"][:8] + "0400" + golden.FILES["tiff", "big_tiff_tiles"][12:], "INVALID_ARGUMENT"),
    ("directory outside", _STRIP[:8] + "ffff0000" + _STRIP[16:], "INVALID_ARGUMENT"),
    ("no directory", _STRIP[:8] + "00000000" + _STRIP[16:], "INVALID_ARGUMENT"),
    ("cut directory", _STRIP[:60], "INVALID_ARGUMENT"),
    ("chain that stands still", _STRIP[:260] + "08000000" + _STRIP[268:], "INVALID_ARGUMENT"),
    ("no width", _STRIP[:20] + "fefe" + _STRIP[24:], "NOT_FOUND"),
    ("wide tag", _STRIP[:28] + "ffffffff" + _STRIP[36:], "INVALID_ARGUMENT"),
    ("two widths", _STRIP[:28] + "02000000" + _STRIP[36:], "INVALID_ARGUMENT"),
]


@query(_values([(n, c) for n, _, c in DAMAGED], "name, code"))
def damaged_files(spark, sf_dir):
    @pandas_udf("string")
    def code(data: pd.Series) -> pd.Series:
        def one(d: bytes) -> str:
            try:
                tiff.images(lambda at, n: bytes(d)[at : at + n])
            except RasterError as e:
                return e.code
            return "OK"

        return data.map(one)

    return spark.createDataFrame([(n, bytes.fromhex(d)) for n, d, _ in DAMAGED], "name string, content binary").select("name", code("content").alias("code"))


def _written(rows: DataFrame, ddl: str, make) -> DataFrame:
    """rows with columns made in Python: make gives tuples for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromJson(described))
        for batch in batches:
            out = [x for r in batch.to_pylist() for x in make(r)]
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    described = rows.sparkSession.createDataFrame([], ddl).schema.jsonValue()
    return rows.mapInArrow(run, ddl)


SIZES = f"SELECT p_partkey, p_size % 5 * 9 + 7 AS w, p_size % 3 * 20 + 1 AS h, p_partkey % 4 + 1 AS ch, 16 * 16 * (p_partkey % 4 + 1) * [1,2,2,4,4,4,8][p_size % 7 + 1] AS b, {TYPE_OF_SIZE} AS pt FROM part"


@query(
    f"WITH s AS ({SIZES}), p AS (SELECT *, (w + 15) // 16 * ((h + 15) // 16) AS n, [8,16,16,32,32,32,64][list_position(['UInt8','UInt16','Int16','UInt32','Int32','Float32','Float64'], pt)] AS bits FROM s),"
    " q AS (SELECT *, 8 + 2 + 12 * 12 + 4 + 2 * CASE WHEN ch > 2 THEN 2 * ch ELSE 0 END + 2 * CASE WHEN n > 1 THEN 4 * n ELSE 0 END AS start FROM p)"
    " SELECT p_partkey, u.tag, u.v AS \"values\" FROM q, LATERAL (SELECT unnest([256,257,258,259,262,277,284,322,323,324,325,339]) AS tag, unnest([CAST(w AS VARCHAR), CAST(h AS VARCHAR), array_to_string(list_transform(range(ch), lambda i: bits), ','), '1',"
    " CASE WHEN ch = 3 THEN '2' ELSE '1' END, CAST(ch AS VARCHAR), '1', '16', '16', array_to_string(list_transform(range(n), lambda i: start + i * b), ','), array_to_string(list_transform(range(n), lambda i: b), ','),"
    " array_to_string(list_transform(range(ch), lambda i: CASE WHEN pt LIKE 'UInt%' THEN 1 WHEN pt LIKE 'Int%' THEN 2 ELSE 3 END), ',')]) AS v) AS u"
)
def tiff_tags(spark, sf_dir):
    """Every tag of files as they are written: offsets and counts follow from sizes alone."""

    def tags(r: dict) -> list[tuple]:
        image = tiff.Image(r["w"], r["h"], r["pt"], r["ch"], 16, 16)
        data = tiff.write([image], [[bytes(image.tile_bytes(0))] * (image.cols * image.rows)])
        (found,) = tiff.images(lambda at, n: data[at : at + n])
        return [(r["p_partkey"], tag, ",".join(map(str, values))) for tag, values in found.tags.items()]

    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (size % 5 * 9 + 7).alias("w"), (size % 3 * 20 + 1).alias("h"), (key % 4 + 1).cast("int").alias("ch"), _pixel_type().alias("pt"))
    return _written(views.spread(rows), "p_partkey bigint, tag int, values string", tags)


@query(
    "SELECT event_id, repeat('81' || x, n // 128) || CASE n % 128 WHEN 0 THEN '' WHEN 1 THEN '00' || x ELSE printf('%02X', 257 - n % 128) || x END AS packed"
    " FROM (SELECT event_id, event_id % 400 + 1 AS n, printf('%02X', 65 + user_id % 26) AS x FROM events)"
)
def packbits_runs(spark, sf_dir):
    data = F.expr("repeat(chr(cast(65 + user_id % 26 as int)), cast(event_id % 400 + 1 as int))").cast("binary")
    return table(spark, sf_dir, "events").select("event_id", F.hex(codecs.encode_column("PackBits")(data)).alias("packed"))


def _nine_bits(codes: list[int]) -> str:
    whole = "".join(f"{c:09b}" for c in codes)
    whole += "0" * (-len(whole) % 8)
    return "".join(f"{int(whole[i : i + 8], 2):02X}" for i in range(0, len(whole), 8))


# What a codec reads, and the bytes that it gives: examples of the formats' own descriptions, and blocks stored as they are.
STREAMS = [
    ("LZW", _nine_bits([256, 7, 258, 8, 8, 258, 6, 6, 257]), "070707080807070606"),
    ("PackBits", "FEAA0280002AFDAA0380002A22F7AA", "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"),
    ("PackBits", "80FEAA", "AAAAAA"),
    ("Deflate", "7801010300FCFF616263024D0127", "616263"),
    ("Zlib", "7801010300FCFF616263024D0127", "616263"),
    ("Zstd", "28B52FFD2003190000616263", "616263"),
    ("Zstd", "28B52FFD20052B000041", "4141414141"),
    ("None", "0102", "0102"),
]


@query(_values([(i, c, d) for i, (c, _, d) in enumerate(STREAMS)], "id, codec, data"))
def golden_streams(spark, sf_dir):
    rows = spark.createDataFrame([(i, c, bytes.fromhex(p), len(d) // 2) for i, (c, p, d) in enumerate(STREAMS)], "id int, codec string, packed binary, size int")
    return _written(rows, "id int, codec string, data string", lambda r: [(r["id"], r["codec"], codecs.DECODERS[r["codec"]](r["packed"], r["size"]).hex().upper())])


LABELLED = f"SELECT p_partkey, p_size % 7 + 1 AS w, p_size % 3 + 1 AS h, ['UInt8','UInt16','UInt32','Float32','Float64'][p_size % 5 + 1] AS pt, [1,2,4,4,8][p_size % 5 + 1] AS s FROM part"
_SIDES = "'<imageHeight>' || h || '</imageHeight><imageWidth>' || w || '</imageWidth><pixelType>' || pt || '</pixelType>'"
_LABELS = {
    "raw": "'{\"fields\": {\"imageWidth\": \"' || w || '\", \"imageHeight\": \"' || h || '\", \"pixelType\": \"' || pt || '\"}}'",
    "pds4": f"'<Product_Observational><Array_2D_Image>' || {_SIDES} || '</Array_2D_Image></Product_Observational>'",
    "isis": "concat_ws(chr(10), 'Object = IsisCube', '  Object = Core', '    Group = Dimensions', '      Samples = ' || w, '      Lines = ' || h, '      Bands = 1', '    End_Group', '    Group = Pixels', '      Type = ' ||"
    " ['UnsignedByte','UnsignedWord','UnsignedInteger','Real','Double'][p_partkey0], '      ByteOrder = Lsb', '      Compression = \"None\"', '    End_Group', '  End_Object', 'End_Object', 'End', '')",
    "chunked": "'{\"chunks\":[' || h || ',' || w || '],\"compressor\":\"none\",\"dtype\":\"' || ['|u1','<u2','<u4','<f4','<f8'][p_partkey0] || '\",\"shape\":[' || h || ',' || w || ']}'",
}


def _label_sql(kind: str, label: str) -> str:
    size = f"{_le('length(label)', 8)} || " if kind in ("pds4", "chunked") else ""
    slot = f"{_le('w * h * s', 4)} || " if kind == "chunked" else ""
    return f"SELECT p_partkey, '{kind}' AS container, {size}hex(label) || {slot}repeat('05', w * h * s) AS content FROM (SELECT *, {label} AS label FROM l)"


@query(f"WITH l AS (SELECT *, list_position(['UInt8','UInt16','UInt32','Float32','Float64'], pt) AS p_partkey0 FROM ({LABELLED})) " + " UNION ALL ".join(_label_sql(k, v) for k, v in _LABELS.items()))
def labelled_files(spark, sf_dir):
    """Whole files of the labelled containers, byte for byte."""

    def files(r: dict) -> list[tuple]:
        held = {"imageWidth": str(r["w"]), "imageHeight": str(r["h"]), "pixelType": r["pt"]}
        data = b"\5" * (r["w"] * r["h"] * samples.TYPES[r["pt"]][0])
        return [(r["p_partkey"], kind, containers.write(kind, held, [data]).hex().upper()) for kind in _LABELS]

    kind = F.element_at(F.array(*(F.lit(t) for t in ("UInt8", "UInt16", "UInt32", "Float32", "Float64"))), F.col("p_size") % 5 + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7 + 1).alias("w"), (F.col("p_size") % 3 + 1).alias("h"), kind.alias("pt"))
    return _written(views.spread(rows), "p_partkey bigint, container string, content string", files)


def _exr_attribute(name: str, kind: str, size: int, value: str) -> str:
    return f"hex('{name}') || '00' || hex('{kind}') || '00' || {_le(str(size), 4)} || {value}"


_EXR = " || ".join(
    [
        "'762F310102000000'", _exr_attribute("channels", "chlist", 19, f"hex('Y') || '00' || {_le('0', 4)} || '00000000' || {_le('1', 4)} || {_le('1', 4)} || '00'"), _exr_attribute("compression", "compression", 1, "'00'"),
        _exr_attribute("dataWindow", "box2i", 16, f"{_le('0', 8)} || {_le('w - 1', 4)} || {_le('1', 4)}"), _exr_attribute("displayWindow", "box2i", 16, f"{_le('0', 8)} || {_le('w - 1', 4)} || {_le('1', 4)}"),
        _exr_attribute("lineOrder", "lineOrder", 1, "'00'"), _exr_attribute("pixelAspectRatio", "float", 4, "'0000803F'"), _exr_attribute("screenWindowCenter", "v2f", 8, "'0000000000000000'"),
        _exr_attribute("screenWindowWidth", "float", 4, "'0000803F'"), "'00'",
    ]
)


@query(
    f"WITH p AS (SELECT p_partkey, p_size % 3 + 1 AS w FROM part), h AS (SELECT *, {_EXR} AS head FROM p)"
    f" SELECT p_partkey, head || {_le('length(head) // 2 + 16', 8)} || {_le('length(head) // 2 + 24 + 4 * w', 8)} || {_le('0', 4)} || {_le('4 * w', 4)} || repeat({_le('p_partkey', 4)}, w) || {_le('1', 4)} || {_le('4 * w', 4)} || repeat({_le('p_partkey', 4)}, w) AS content,"
    f" repeat({_le('p_partkey', 4)}, 2 * w) AS again, CAST(8 * w AS BIGINT) AS n_bytes FROM h"
)
def exr_files(spark, sf_dir):
    """Whole OpenEXR files, byte for byte, and their samples read back."""

    def file(r: dict) -> list[tuple]:
        data = np.full(2 * r["w"], r["p_partkey"], "<u4").tobytes()
        whole = containers.write("exr", {"imageWidth": str(r["w"]), "imageHeight": "2", "pixelType": "UInt32"}, [data])
        (image,) = containers.parse("exr", whole)
        return [(r["p_partkey"], whole.hex().upper(), containers.tile("exr", lambda at, n: whole[at : at + n], image, 0, 0).hex().upper(), containers.exr_bytes(image))]

    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3 + 1).alias("w"))
    return _written(views.spread(rows), "p_partkey bigint, content string, again string, n_bytes bigint", file)


_RECORD = f"{_le('octet_length(encode(key))', 2)} || hex(key) || {_le('octet_length(encode(value))', 4)} || hex(value)"


@query(
    f"WITH e AS ({ENTRIES}) SELECT event_id, hex('IMAGE') || '0100' || {_le('count(*)', 4)} || string_agg({_RECORD}, '' ORDER BY key) AS content, CAST(count(*) AS INTEGER) AS n, max(value) FILTER (WHERE key = 'image.layers.dem') AS dem FROM e GROUP BY event_id"
)
def payload_files(spark, sf_dir):
    """Payloads of metadata tags, byte for byte, and a field read back."""

    def made(r: dict) -> list[tuple]:
        data = payload.encode(dict(r["fields"]), "image")
        found = payload.decode(data)[1]
        return [(r["event_id"], data.hex().upper(), len(found), found["image.layers.dem"])]

    return _written(views.field_maps(spark, sf_dir).select("event_id", "fields"), "event_id bigint, content string, n int, dem string", made)


# JSON texts and their canonical forms.
CANONICAL = [
    ('{"b":1.0,"a":[true,null,"x"]}', '{"a":[true,null,"x"],"b":1}'),
    ('{"\\ud83d\\ude00":1,"\\ufb33":2}', '{"\U0001f600":1,"דּ":2}'),
    ('"\\u000f\\n\\u0041\\"\\\\/"', '"\\u000f\\nA\\"\\\\/"'),
    ("[1e21,1e20,1E-6,1e-7,0.1,-0.0]", "[1e+21,100000000000000000000,0.000001,1e-7,0.1,0]"),
    ("[333333333.33333329,4.50,2e-3,0.000000000000000000000000001]", "[333333333.3333333,4.5,0.002,1e-27]"),
    ('{"1":{"f":{"f":"hi","F":5},"\\n":56.0},"10":{},"":"empty","a":{},"111":[{"e":"yes","E":"no"}],"A":{}}', '{"":"empty","1":{"\\n":56,"f":{"F":5,"f":"hi"}},"10":{},"111":[{"E":"no","e":"yes"}],"A":{},"a":{}}'),
]


@query(_values([(i, c) for i, (_, c) in enumerate(CANONICAL)], "id, json"))
def canonical_texts(spark, sf_dir):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CANONICAL)], "id int, text string")
    return rows.select("id", canonical.canonical("text").alias("json"))


@query("SELECT c_custkey, '{\"balance\":' || CASE WHEN c_acctbal = trunc(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END || ',\"name\":\"' || c_name || '\"}' AS json FROM customer")
def canonical_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", canonical.canonical(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))).alias("json"))


# Sample kernels and statistics


@query(f"SELECT vec_id, x, CAST(sum(q) OVER (PARTITION BY vec_id ORDER BY x ROWS UNBOUNDED PRECEDING) % 256 AS BIGINT) AS sample FROM ({SAMPLES8})")
def predictor_undo(spark, sf_dir):
    """Samples taken as residuals."""
    return kernels.predictor_undo(views.samples8(spark, sf_dir), ["vec_id"], "x", "q", 8).select("vec_id", "x", "sample")


ODD = "SELECT user_id % 40 AS k, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 13 = 0 THEN '-Infinity'::DOUBLE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events"


@query(
    f"WITH p AS (SELECT * FROM ({ODD}) WHERE isfinite(v)), s AS (SELECT k, min(v) AS lo, max(v) AS hi, avg(v) AS mean, count(*) AS total FROM p GROUP BY k)"
    " SELECT k, CAST(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 63) ELSE 0 END AS INTEGER) AS bin, count(*) AS n, CAST(trunc(lo + (hi - lo) * (bin + 0.5) / 64) AS BIGINT) AS label, any_value(total) AS total, any_value(round(mean, 9)) AS mean_value"
    " FROM p JOIN s USING (k) GROUP BY k, bin, lo, hi"
)
def histogram_odd(spark, sf_dir):
    """Null, NaN and infinite samples take no part."""
    e = F.col("event_id")
    v = F.when(e % 7 == 0, float("nan")).when(e % 11 == 0, float("inf")).when(e % 13 == 0, float("-inf")).when(e % 17 == 0, None).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("k"), v.alias("value"))
    found = stats.channel_stats(rows, ["k"]).select("k", F.col("n").alias("total"), F.round("mean_value", 9).alias("mean_value"))
    return stats.histogram(rows, ["k"]).join(found, "k")


# Names, codes and numbers


@query(
    f"SELECT p_partkey, p_size % 9 AS code, coalesce(['UInt8','UInt16','UInt32','Float32','Float64','Int16','Int32'][p_size % 9 + 1], 'UInt8') AS from_code, [0,1,5,2,6,3,4][p_size % 7 + 1] AS to_code,"
    " CASE WHEN ['pinhole','fisheye','pushbroom','odd'][p_size % 4 + 1] = 'odd' THEN 'pinhole' ELSE ['pinhole','fisheye','pushbroom','odd'][p_size % 4 + 1] END AS lens,"
    " ['Observation','DataObject','Product','ProcessRecord'][p_size % 4 + 1] AS entity, p_size % 2 = 0 AS uniform, CAST(p_size AS DOUBLE) / 4 AS k1, CAST(p_size AS VARCHAR) AS tag, CAST(w * h AS BIGINT) * t * t AS product"
    f" FROM (SELECT l.*, l.p_size AS s FROM ({LAYOUTS}) AS l)"
)
def names_and_codes(spark, sf_dir):
    """Codes of sample types, kinds of lenses, entity names, parameters that are looked up and set, checked products."""
    size = F.col("p_size")
    pick = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), size % len(names) + 1)
    rows = views.layouts(spark, sf_dir)
    parameters = fields.upsert(F.create_map(F.lit("tag"), F.lit("old")), F.lit("tag"), size.cast("string"))
    bits = F.array(F.lit(8), F.when(size % 2 == 0, 8).otherwise(16))
    return rows.select(
        "p_partkey", (size % 9).alias("code"), samples.from_code(size % 9).alias("from_code"), samples.to_code(_pixel_type()).alias("to_code"), fields.lens_kind(pick("pinhole", "fisheye", "pushbroom", "odd")).alias("lens"),
        graph.entity_name(pick(*graph.ENTITY_TYPES)).alias("entity"), samples.uniform_bits(bits).alias("uniform"), fields.parameter(F.create_map(F.lit("k1"), size / 4), "k1").alias("k1"), fields.parameter(parameters, "tag").alias("tag"),
        (F.col("w") * F.col("h") * F.col("t") * F.col("t")).cast("bigint").alias("product"),
    )


@query("SELECT codec, n, CASE codec WHEN 'None' THEN n WHEN 'Zlib' THEN n + n // 1000 + 64 ELSE n + n // 256 + 64 END AS bound FROM (SELECT DISTINCT p_size * 100 AS n FROM part), (VALUES ('None'), ('Zlib'), ('Zstd')) AS c(codec)")
def payload_bounds(spark, sf_dir):
    """The most that a chunk can take; noise never takes more."""

    def bounds(r: dict) -> list[tuple]:
        noise = np.random.default_rng(r["n"]).integers(0, 256, r["n"], np.uint8).tobytes()
        out = []
        for codec in ("None", "Zlib", "Zstd"):
            most = codecs.payload_bound(codec, r["n"])
            out.append((codec, r["n"], most if len(codecs.ENCODERS[codec](noise)) <= most else -1))
        return out

    return _written(table(spark, sf_dir, "part").select((F.col("p_size") * 100).alias("n")).distinct(), "codec string, n int, bound int", bounds)


CAMERAS = "SELECT c_custkey, c_name, c_nationkey, c_custkey % 4 AS q FROM customer"


def _camera():
    """A typed camera of a customer; its numbers are halves."""
    half = lambda c: (F.col(c) + 0.5).cast("double")
    number = lambda c: F.lit(float(c))
    return F.struct(
        F.col("c_name").alias("model"), half("c_nationkey").alias("fx"), number(715).alias("fy"), number(8).alias("cx"), number(9).alias("cy"), F.struct(number(1).alias("w"), number(0).alias("x"), number(0).alias("y"), half("c_nationkey").alias("z")).alias("rotation"),
        F.struct(number(1).alias("x"), number(2).alias("y"), half("c_nationkey").alias("z")).alias("position"), F.when(F.col("c_custkey") % 2 == 0, "2026-01-01T00:00:00Z").otherwise("").alias("timestamp"),
        F.struct(F.lit("fisheye").alias("kind"), F.create_map(F.lit("k1"), number(0.25)).alias("parameters")).alias("lens"),
    )


_HALF = "CAST(c_nationkey + 0.5 AS VARCHAR)"
_CAMERA_ROWS = (
    "[struct_pack(k := 'model', v := c_name), struct_pack(k := 'timestamp', v := CASE WHEN c_custkey % 2 = 0 THEN '2026-01-01T00:00:00Z' END),"
    + ", ".join(f"struct_pack(k := '{k}', v := {v})" for k, v in [("focal_length_x", _HALF), ("focal_length_y", "'715.0'"), ("principal_x", "'8.0'"), ("principal_y", "'9.0'"), ("rotation_w", "'1.0'"), ("rotation_x", "'0.0'"), ("rotation_y", "'0.0'"), ("rotation_z", _HALF), ("position_x", "'1.0'"), ("position_y", "'2.0'"), ("position_z", _HALF), ("lens_kind", "'fisheye'"), ("lens.k1", "'0.25'")])
    + "]"
)
CAMERA_FIELDS = f"SELECT c_custkey, c_nationkey, 'image.camera.' || u.e.k AS key, u.e.v AS value FROM customer, LATERAL (SELECT unnest({_CAMERA_ROWS}) AS e) AS u WHERE u.e.v IS NOT NULL"


@query(f"SELECT c_custkey, key, value FROM ({CAMERA_FIELDS})")
def camera_to_fields(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(fields.camera_fields(_camera())).alias("key", "value"))


@query(
    "SELECT n_nationkey, 'image.crs.' || u.e[1] AS key, u.e[2] AS value FROM nation, LATERAL (SELECT unnest([['body', CAST(n_nationkey AS VARCHAR)], ['projection', 'sinusoidal'], ['reference_frame', n_name]]) AS e) AS u"
    " UNION ALL SELECT n_nationkey, 'image.scene.geometry.' || u.e[1], u.e[2] FROM nation, LATERAL (SELECT unnest([['kind', 'unspecified'], ['source_image', CAST(n_regionkey AS VARCHAR)], ['param.tag', n_name]]) AS e) AS u"
)
def typed_to_fields(spark, sf_dir):
    """Coordinate systems and scene geometries as fields."""
    crs = F.struct(F.lit("any").alias("planet"), F.col("n_nationkey").cast("string").alias("iau_id"), F.col("n_name").alias("frame"), F.struct(F.lit("sinusoidal").alias("kind")).alias("projection"))
    made = fields.geometry_fields(F.lit("unspecified"), F.col("n_regionkey"), F.create_map(F.lit("tag"), F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.map_concat(fields.crs_fields(crs), made)).alias("key", "value"))


@query(f"SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE {BODY} WHEN '301' THEN 'Moon' WHEN '499' THEN 'Mars' ELSE coalesce({BODY}, 'Vesta') END, n_nationkey) AS INTEGER) AS place FROM nation")
def planets_in_order(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("n_nationkey") % 4
    body = F.when(k == 0, "301").when(k == 1, "499").when(k == 2, F.col("n_nationkey").cast("string"))
    crs = F.struct(F.coalesce(fields.planet_name(body), F.lit("Vesta")).alias("planet"), F.lit("").alias("iau_id"), F.lit("").alias("frame"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(*fields.by_planet(crs), "n_nationkey")).alias("place"))


# Scenes


@query(
    "SELECT c_nationkey AS scene_id, c_custkey AS image, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 2, c_custkey) - 1 AS id FROM customer"
)
def entities_added(spark, sf_dir):
    """Customers as images of a scene: those with even keys first, then the others, which get the next ids."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene_id"), F.col("c_custkey").alias("image"))
    first = graph.with_ids(rows.where("image % 2 = 0"), "image", ["scene_id"])
    return graph.added(first, rows.where("image % 2 = 1"), "image", ["scene_id"]).withColumn("id", F.col("id").cast("bigint"))


@query(
    "WITH e AS (SELECT c_nationkey AS scene_id, c_custkey AS image, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS id FROM customer), w AS (SELECT n_nationkey AS scene_id, CAST(i AS BIGINT) AS wanted FROM nation, (VALUES (0), (5), (100000)) AS v(i))"
    " SELECT w.scene_id, wanted, 'id' AS how, image, image IS NOT NULL AS found FROM w LEFT JOIN e ON e.scene_id = w.scene_id AND e.id = wanted"
    " UNION ALL SELECT w.scene_id, wanted, 'place', image, image IS NOT NULL FROM w LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY id) - 1 AS place FROM e WHERE id % 2 = 1) AS e ON e.scene_id = w.scene_id AND e.place = wanted"
)
def entity_lookup(spark, sf_dir):
    """By id, and by place among those with odd ids; a miss says so."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene_id"), F.col("c_custkey").alias("image"))
    entities = graph.with_ids(rows, "image", ["scene_id"]).withColumn("id", F.col("id").cast("bigint"))
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scene_id"), F.explode(F.array(*(F.lit(i).cast("bigint") for i in (0, 5, 100_000)))).alias("wanted"))
    by_id = graph.by_id(entities, wanted.withColumn("id", F.col("wanted")), ["scene_id"]).withColumn("how", F.lit("id"))
    placed = graph.at_place(entities.where("id % 2 = 1"), wanted.withColumn("place", F.col("wanted")), ["scene_id"]).withColumn("how", F.lit("place"))
    return by_id.select("scene_id", "wanted", "how", "image", "found").unionByName(placed.select("scene_id", "wanted", "how", "image", "found"))


def _images(spark, sf_dir):
    """Customers as images of their nation's scene; a third have a camera, all a field."""
    c = table(spark, sf_dir, "customer").where("c_nationkey < 5")
    rows = c.select(
        F.col("c_nationkey").alias("scene_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") + 10).alias("width"), F.lit(20).cast("bigint").alias("height"), (F.col("c_custkey") % 3 + 1).cast("int").alias("channel_count"),
        F.when(F.col("c_custkey") % 2 == 0, "UInt8").otherwise("Float32").alias("pixel_type"), F.when(F.col("c_custkey") % 5 == 0, "LZW").alias("compression"), F.lit(16).cast("bigint").alias("tile_w"), F.lit(32).cast("bigint").alias("tile_h"),
        F.when(F.col("c_custkey") % 3 == 0, _camera()).alias("camera"), F.lit(None).cast("struct<planet:string,iau_id:string,frame:string,projection:struct<kind:string,parameters:map<string,double>>>").alias("crs"),
        F.create_map(F.lit("image.spice.frame"), F.col("c_mktsegment")).alias("fields"),
    )
    return rows


TREE = (
    "SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS ordinal, CASE WHEN c_custkey % 2 = 0 THEN 'UInt8' ELSE 'Float32' END AS pt, CASE WHEN c_custkey % 5 = 0 THEN 'LZW' ELSE 'None' END AS comp FROM customer WHERE c_nationkey < 5"
)


@query(
    f"WITH t AS ({TREE}), g AS (SELECT c_nationkey AS n, max(ordinal) + 1 AS images FROM t GROUP BY c_nationkey)"
    " SELECT c_nationkey AS scene_id, ordinal, u.e[1] AS key, u.e[2] AS value FROM t, LATERAL (SELECT unnest([['imageWidth', CAST(c_custkey + 10 AS VARCHAR)], ['imageHeight', '20'], ['samplesPerPixel', CAST(c_custkey % 3 + 1 AS VARCHAR)], ['pixelType', pt], ['compression', comp], ['tileWidth', '16'], ['tileHeight', '32'], ['image.spice.frame', c_mktsegment]]) AS e) AS u"
    f" UNION ALL SELECT t.c_nationkey, ordinal, f.key, f.value FROM t JOIN ({CAMERA_FIELDS}) AS f USING (c_custkey) WHERE c_custkey % 3 = 0"
    " UNION ALL SELECT n_nationkey, images, u.e[1], u.e[2] FROM nation JOIN g ON n = n_nationkey, LATERAL (SELECT unnest([['image.scene.object_type', 'geometry'], ['image.scene.geometry.kind', 'unspecified'], ['image.scene.geometry.source_image', '0'], ['image.scene.geometry.param.tag', n_name]]) AS e) AS u"
)
def scene_tree(spark, sf_dir):
    """Scenes as child nodes of flat fields: images, then a geometry of each scene."""
    return _tree(spark, sf_dir).select("scene_id", "ordinal", F.explode("fields").alias("key", "value"))


def _tree(spark, sf_dir):
    own = table(spark, sf_dir, "nation").where("n_nationkey < 5").join(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey")
    geometries = own.select(F.col("n_nationkey").alias("scene_id"), F.lit(0).cast("bigint").alias("id"), F.lit("unspecified").alias("kind"), F.lit(0).cast("bigint").alias("source_image"), F.create_map(F.lit("tag"), F.col("n_name")).alias("parameters"))
    return storage.serialised(_images(spark, sf_dir), geometries=geometries)


@query(
    f"WITH t AS ({TREE}) SELECT c_nationkey AS scene_id, ordinal AS id, c_custkey + 10 AS width, CAST(c_custkey % 3 + 1 AS INTEGER) AS channel_count, pt AS pixel_type, comp AS compression, CAST(16 AS BIGINT) AS tile_w,"
    " CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 0.5::DOUBLE END AS fx, CASE WHEN c_custkey % 3 = 0 THEN 'fisheye' END AS lens, c_mktsegment AS frame, CAST(1 AS INTEGER) AS n_fields, n_name AS tag FROM t JOIN nation ON n_nationkey = c_nationkey"
)
def scene_from_tree(spark, sf_dir):
    """The same scenes, typed again, with the tag of their geometry."""
    tree = _tree(spark, sf_dir)
    tags = storage.geometries(tree).select("scene_id", F.try_element_at("geometry.parameters", F.lit("tag")).alias("tag"))
    return storage.images(tree).join(tags, "scene_id").select(
        "scene_id", "id", "width", "channel_count", "pixel_type", "compression", "tile_w", F.col("camera.fx").alias("fx"), F.col("camera.lens.kind").alias("lens"), F.try_element_at("fields", F.lit("image.spice.frame")).alias("frame"), F.size("fields").alias("n_fields"), "tag"
    )


# Motions: SQL by Rodrigues' formula


def _cross(a: tuple, b: tuple) -> tuple:
    return tuple(f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))


def _exp_sql(s: str) -> tuple[tuple, tuple]:
    """SQL of the unit axis, and the translation, of the motion s times (v, w); v, w, th are columns."""
    w, v = ("wx", "wy", "wz"), ("vx", "vy", "vz")
    first = _cross(w, v)
    second = _cross(w, first)
    # Of s (v, w): v s + (1 - cos) / th^2 (w x v) + (th s - sin) / th^3 (w x (w x v)).
    t = tuple(f"({v[i]} * {s} + (1 - cos(th * {s})) / (th * th) * {first[i]} + (th * {s} - sin(th * {s})) / (th * th * th) * {second[i]})" for i in range(3))
    return tuple(f"({x} / th)" for x in w), t


def _turned_sql(s: str, p: tuple) -> tuple:
    """SQL of a point turned about w by the angle s th."""
    axis, _ = _exp_sql(s)
    across = _cross(axis, p)
    along = " + ".join(f"{k} * ({x})" for k, x in zip(axis, p, strict=True))
    return tuple(f"(({p[i]}) * cos(th * {s}) + {across[i]} * sin(th * {s}) + {axis[i]} * ({along}) * (1 - cos(th * {s})))" for i in range(3))


TWISTS = "SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS th FROM (SELECT s_suppkey, s_acctbal / 1000 AS a, s_acctbal / 1000 AS vx, 0.2 AS vy, -0.3 AS vz, (s_suppkey % 7 + 1) / 10 AS wx, (s_suppkey % 5) / 10 - 0.2 AS wy, 0.4 AS wz FROM supplier)"


def _select(columns: dict[str, str], rest: str) -> str:
    return f"SELECT s_suppkey, {', '.join(f'round(CAST({e} AS DOUBLE), 9) + 0.0 AS {n}' for n, e in columns.items())} {rest}"


def _twists(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("a"), ((k % 7 + 1) / 10).alias("wx"), ((k % 5) / 10 - 0.2).alias("wy"))
    return rows, (F.col("a"), F.lit(0.2), F.lit(-0.3)), (F.col("wx"), F.col("wy"), F.lit(0.4))


def _columns(parts: tuple, names: str):
    return [c.alias(n) for c, n in zip(parts, names.split(), strict=True)]


_AXIS, _SHIFT = _exp_sql("1")


@query(_select({"qw": "cos(th / 2)", **{f"q{n}": f"{k} * sin(th / 2)" for n, k in zip("xyz", _AXIS, strict=True)}, **{f"t{n}": t for n, t in zip("xyz", _SHIFT, strict=True)}}, f"FROM ({TWISTS})"))
def pose_exp(spark, sf_dir):
    rows, v, w = _twists(spark, sf_dir)
    q, t = geometry.exp(v, w)
    return _rounded(rows.select("s_suppkey", *_columns(q, "qw qx qy qz"), *_columns(t, "tx ty tz")), "s_suppkey")


LOG = f"SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END / sqrt(x*x + y*y + z*z) * 2 * atan2(sqrt(x*x + y*y + z*z), abs(w)) AS f, 2 * atan2(sqrt(x*x + y*y + z*z), abs(w)) AS th FROM ({QUAT})"
_W, _T = ("(f * x)", "(f * y)", "(f * z)"), ("a", "2.0", "3.0")
_WT = _cross(_W, _T)
_WWT = _cross(_W, _WT)


@query(_select({**{f"v{n}": f"{_T[i]} - 0.5 * {_WT[i]} + (1 / (th * th) - (1 + cos(th)) / (2 * th * sin(th))) * {_WWT[i]}" for i, n in enumerate("xyz")}, **{f"w{n}": _W[i] for i, n in enumerate("xyz")}}, f"FROM ({LOG})"))
def pose_log(spark, sf_dir):
    rows, q = _posed(spark, sf_dir)
    linear, angular = geometry.log((q, (F.col("a"), F.lit(2.0), F.lit(3.0))))
    return _rounded(rows.select("s_suppkey", *_columns(linear, "vx vy vz"), *_columns(angular, "wx wy wz")), "s_suppkey")


_R = ["1 - 2*(y*y + z*z)", "2*(x*y - w*z)", "2*(x*z + w*y)", "2*(x*y + w*z)", "1 - 2*(x*x + z*z)", "2*(y*z - w*x)", "2*(x*z - w*y)", "2*(y*z + w*x)", "1 - 2*(x*x + y*y)"]
_times = lambda p: tuple(" + ".join(f"({_R[i * 3 + j]}) * ({p[j]})" for j in range(3)) for i in range(3))
_back = lambda p: tuple(" + ".join(f"({_R[j * 3 + i]}) * ({p[j]})" for j in range(3)) for i in range(3))


@query(_select(dict(zip("xyz", _back(("2.0 - a", "-2.0", "-5.0")), strict=True)), f"FROM ({QUAT})"))
def pose_relative(spark, sf_dir):
    """A quarter turn about x as seen from a pose, at a point."""
    rows, q = _posed(spark, sf_dir)
    zero = F.lit(0.0)
    between = geometry.relative((q, (F.col("a"), F.lit(2.0), F.lit(3.0))), (geometry.quarter_turn(), (F.lit(1.0), F.col("a"), zero)))
    return _rounded(rows.select("s_suppkey", *_columns(geometry.act(between, (F.lit(1.0), F.lit(-2.0), F.col("a"))), "x y z")), "s_suppkey")


_CARRIED = _times(("0.1", "0.2", "0.4"))
_LINEAR = [f"{r} + {c}" for r, c in zip(_times(("a", "0.5", "-1.0")), _cross(("a", "2.0", "3.0"), _CARRIED), strict=True)]


@query(_select({**{f"v{n}": e for n, e in zip("xyz", _LINEAR, strict=True)}, **{f"w{n}": e for n, e in zip("xyz", _CARRIED, strict=True)}, "by_matrix": f"({_LINEAR[0]}) + 10 * ({_LINEAR[2]}) + 100 * ({_CARRIED[1]})"}, f"FROM ({QUAT})"))
def twist_transform(spark, sf_dir):
    """A twist carried by a pose that turns and shifts: by formula, and by the adjoint matrix."""
    rows, q = _posed(spark, sf_dir)
    pose = (q, (F.col("a"), F.lit(2.0), F.lit(3.0)))
    linear, angular = (F.col("a"), F.lit(0.5), F.lit(-1.0)), (F.lit(0.1), F.lit(0.2), F.lit(0.4))
    v, w = geometry.transform_twist(pose, linear, angular)
    m = geometry.adjoint(pose)
    by = [sum((m[i * 6 + j] * x for j, x in enumerate((*linear, *angular))), F.lit(0.0)) for i in range(6)]
    return _rounded(rows.select("s_suppkey", *_columns(v, "vx vy vz"), *_columns(w, "wx wy wz"), (by[0] + by[2] * 10 + by[4] * 100).alias("by_matrix")), "s_suppkey")


def _moved(s: str, p: tuple) -> tuple:
    return tuple(f"{a} + {b}" for a, b in zip(_turned_sql(s, p), _exp_sql(s)[1], strict=True))


_PART = _moved("0.25", ("1.0", "-2.0", "0.5"))


@query(_select({"x": f"{_PART[0]} + 1.0", "y": f"-({_PART[2]}) + a", "z": f"{_PART[1]}"}, f"FROM ({TWISTS})"))
def pose_interpolated(spark, sf_dir):
    """A quarter of the way from a quarter turn about x to the same after a twist, at a point."""
    rows, v, w = _twists(spark, sf_dir)
    start = (geometry.quarter_turn(), (F.lit(1.0), F.col("a"), F.lit(0.0)))
    rows, end = geometry.settled(rows, "end", *geometry.compose(start, geometry.exp(v, w)))
    rows, between = geometry.interpolated(rows, "between", start, end, F.lit(0.25))
    return _rounded(rows.select("s_suppkey", *_columns(geometry.act(between, (F.lit(1.0), F.lit(-2.0), F.lit(0.5))), "x y z")), "s_suppkey")


@query(_select({**dict(zip("xyz", _moved("1.5", ("1.0", "-2.0", "0.5")), strict=True)), "back_x": "1.0", "back_y": "-2.0", "magnitude": "th"}, f"FROM ({TWISTS})"))
def screw_motion(spark, sf_dir):
    """A point moved along a screw and back; the screw comes as an array of six."""
    rows, v, w = _twists(spark, sf_dir)
    linear, angular = geometry.screw(F.array(*v, *w))
    point = (F.lit(1.0), F.lit(-2.0), F.lit(0.5))
    rows, motion = geometry.settled(rows, "motion", *geometry.screw_motion(linear, angular, F.lit(1.5)))
    rows, there = geometry.settled(rows, "there", geometry.act(motion, point))
    rows, undone = geometry.settled(rows, "undone", *geometry.invert(motion))
    back = geometry.act(undone, there[0])
    return _rounded(rows.select("s_suppkey", *_columns(there[0], "x y z"), *_columns(back[:2], "back_x back_y"), geometry.screw_magnitude(angular).alias("magnitude")), "s_suppkey")


_AT = _moved("0.5", ("1.0", "a", "0.0"))


@query(_select({"x": _AT[0], "y": _AT[1], "z": _AT[2], "twist_0": "vx", "twist_4": "wy", "carried_x": "vx", "carried_wy": "-wz", "rest": "0.0", "position_y": "a"}, f"FROM ({TWISTS})"))
def states(spark, sf_dir):
    """States from poses and twists, at rest, propagated along their screw, and with velocities carried by a quarter turn about x."""
    rows, v, w = _twists(spark, sf_dir)
    pose = (geometry.quarter_turn(), (F.lit(1.0), F.col("a"), F.lit(0.0)))
    rows = rows.withColumns({"state": geometry.state(pose, v, w), "resting": geometry.state(pose)})
    s = F.col("state")
    rows, step = geometry.settled(rows, "step", *geometry.screw_motion(geometry.vec(s["linear_velocity"]), geometry.vec(s["angular_velocity"]), F.lit(0.5)))
    _, at = geometry.compose(step, geometry.state_pose(s))
    twist = geometry.state_twist(s)
    carried = geometry.state_velocity_in(s, (geometry.quarter_turn(), (F.lit(0.0),) * 3))
    rest = F.aggregate(geometry.state_twist(F.col("resting")), F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return _rounded(
        rows.select(
            "s_suppkey", *_columns(at, "x y z"), twist[0].alias("twist_0"), twist[4].alias("twist_4"), carried["linear_velocity"]["x"].alias("carried_x"), carried["angular_velocity"]["y"].alias("carried_wy"), rest.alias("rest"), s["position"]["y"].alias("position_y")
        ),
        "s_suppkey",
    )


@query(
    _select(
        {"nx": "a / sqrt(a*a + 13)", "ny": "2 / sqrt(a*a + 13)", "zero": "0.0", "angle": "2 * atan2(sqrt(x*x + y*y + z*z), abs(w))", "axis_y": "CASE WHEN w < 0 THEN -1 ELSE 1 END * y / sqrt(x*x + y*y + z*z)",
         "qw": "w", "pitch_degrees": "degrees(pitch)", "yaw_degrees": "degrees(yaw)", "position_x": "a", "rotation_y": "y"},
        f"FROM ({QUAT})",
    )
)
def vectors_and_angles(spark, sf_dir):
    """Normalised vectors, axis and angle, Euler angles in degrees, a camera's pose taken out and put back."""
    rows, q = _posed(spark, sf_dir)
    axis, angle = geometry.to_axis_angle(q)
    unit, zero = geometry.normalise((F.col("a"), F.lit(2.0), F.lit(3.0))), geometry.normalise((F.lit(0.0),) * 3)
    degrees = geometry.from_euler_degrees(F.degrees("roll"), F.degrees("pitch"), F.degrees("yaw"))
    _, pitch, yaw = geometry.to_euler_degrees(q)
    camera = F.struct(F.lit("m").alias("model"), geometry.quat_struct(geometry.identity()[0]).alias("rotation"), geometry.vec_struct((F.lit(0.0),) * 3).alias("position"))
    turn, place = geometry.pose_of_extrinsics(geometry.with_extrinsics(camera, (q, (F.col("a"), F.lit(2.0), F.lit(3.0)))))
    out = rows.select("s_suppkey", unit[0].alias("nx"), unit[1].alias("ny"), zero[0].alias("zero"), angle.alias("angle"), axis[1].alias("axis_y"), degrees[0].alias("qw"), pitch.alias("pitch_degrees"), yaw.alias("yaw_degrees"), place[0].alias("position_x"), turn[2].alias("rotation_y"))
    return _rounded(out, "s_suppkey")


# Files that are written and scanned: an image of 100 by 60 pixels for each nation, in tiles of 32

FILE_TILES = "SELECT n_nationkey, n_name, CAST(i AS BIGINT) AS linear_index, CAST((n_nationkey * 7 + i) % 256 AS BIGINT) AS v, CASE WHEN i % 4 = 3 THEN 4 ELSE 32 END * CASE WHEN i >= 4 THEN 28 ELSE 32 END AS inside FROM nation, range(8) AS r(i)"


def _nation_files(spark: SparkSession, sf_dir: str, **options: str) -> str:
    """Writes them; the folder."""
    folder = views.scratch(spark)
    size = F.lit(32).cast("bigint")
    n = table(spark, sf_dir, "nation").withColumn("linear_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    value = (F.col("n_nationkey") * 7 + F.col("linear_index")) % 256
    frame = F.when(F.col("linear_index") == 0, F.create_map(F.lit("image.spice.frame"), F.col("n_name")))
    rows = n.select(
        F.concat(F.lit(f"{folder}/"), "n_nationkey", F.lit(".img")).alias("path"), F.lit(0).alias("image_index"), F.lit(0).alias("level"), (F.col("linear_index") % 4).alias("tile_col"), F.floor(F.col("linear_index") / 4).alias("tile_row"), "linear_index",
        (F.col("linear_index") % 4 * 32).alias("x"), (F.floor(F.col("linear_index") / 4) * 32).alias("y"), size.alias("tile_w"), size.alias("tile_h"), F.lit("UInt8").alias("pixel_type"), F.lit(1).alias("channel_count"),
        F.array_repeat(value, 1024).alias("samples"), F.lit(100).cast("bigint").alias("width"), F.lit(60).cast("bigint").alias("height"), frame.alias("fields"),
    )
    datasource.write_tiles(rows.withColumn("data", codecs.packed("samples", "pixel_type")), **options)
    return folder


def _number():
    return F.regexp_extract("path", r"(\d+)\.img$", 1).cast("int").alias("n_nationkey")


def _first():
    return F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("bigint").alias("v")


@query("SELECT n_nationkey, CAST(100 AS BIGINT) AS width, CAST(60 AS BIGINT) AS height, CAST(4 AS BIGINT) AS tile_cols, CAST(2 AS BIGINT) AS tile_rows, 'LZW' AS compression, n_name AS frame FROM nation")
def file_scan(spark, sf_dir):
    """Headers of written files: sizes and fields come from the rows, the codec from an option."""
    images = api.read_images(spark, f"{_nation_files(spark, sf_dir, compression='LZW', predictor='2')}/*.img")
    return images.select(_number(), "width", "height", "tile_cols", "tile_rows", "compression", F.try_element_at("fields", F.lit("image.spice.frame")).alias("frame"))


@query(f"SELECT n_nationkey, linear_index, v, CAST(1024 AS INTEGER) AS n_bytes FROM ({FILE_TILES}) WHERE linear_index = 6")
def tile_read(spark, sf_dir):
    """One tile of each file; the filter reaches the reader, which reads its bytes only."""
    rows = api.read_tiles(spark, f"{_nation_files(spark, sf_dir)}/*.img").where("tile_col = 2 and tile_row = 1 and image_index = 0")
    return rows.select(_number(), "linear_index", _first(), F.length("data").alias("n_bytes"))


@query(f"SELECT n_nationkey, CAST(sum(v * inside) AS BIGINT) AS total, CAST(sum(inside) AS BIGINT) AS n FROM ({FILE_TILES}) GROUP BY n_nationkey")
def pixel_scan(spark, sf_dir):
    """Samples inside the images; padding takes no part."""
    pixels = api.read_pixels(spark, f"{_nation_files(spark, sf_dir, compression='Deflate')}/*.img")
    return pixels.groupBy(_number()).agg(F.sum("value").cast("bigint").alias("total"), F.count("*").alias("n"))


@query(f"SELECT n_nationkey, CAST(ox AS BIGINT) AS ox, CAST(oy AS BIGINT) AS oy, CAST(v AS DOUBLE) AS value FROM ({FILE_TILES}), range(10) AS a(ox), range(6) AS b(oy) WHERE linear_index = oy * 10 // 32 * 4 + ox * 10 // 32")
def thumbnails(spark, sf_dir):
    path = f"{_nation_files(spark, sf_dir, compression='PackBits')}/*.img"
    found = api.thumbnail(api.read_pixels(spark, path), api.read_images(spark, path), 10, 6)
    return found.select(_number(), F.col("ox").cast("bigint").alias("ox"), F.col("oy").cast("bigint").alias("oy"), "value")


@query(f"SELECT n_nationkey, n_name AS frame, 'Deflate' AS compression, CAST(sum(v) AS BIGINT) AS total FROM ({FILE_TILES}) GROUP BY n_nationkey, n_name")
def copied_files(spark, sf_dir):
    """A copy keeps tiles and fields; the codec is another."""
    target = views.scratch(spark)
    api.copy(spark, f"{_nation_files(spark, sf_dir)}/*.img", target, compression="Deflate")
    rows = api.read_tiles(spark, f"{target}/*.img")
    frame = F.max(F.try_element_at("fields", F.lit("image.spice.frame"))).alias("frame")
    return rows.withColumn("v", _first()).groupBy(_number()).agg(frame, F.max("compression").alias("compression"), F.sum("v").alias("total"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS container, n_nationkey, linear_index, v FROM ({FILE_TILES})" for k in ("raw", "pds4", "isis", "chunked")))
def container_scan(spark, sf_dir):
    """All tiles of files of the other containers, written through the same sink."""
    out = None
    for kind in ("raw", "pds4", "isis", "chunked"):
        rows = api.read_tiles(spark, f"{_nation_files(spark, sf_dir, container=kind)}/*.img", kind).select(F.lit(kind).alias("container"), _number(), "linear_index", _first())
        out = rows if out is None else out.unionByName(rows)
    return out


class _Ranges(SimpleHTTPRequestHandler):
    """Files of a folder, in ranges."""

    def do_GET(self):
        place = Path(self.translate_path(self.path))
        if not place.is_file():
            self.send_error(404)
            return
        data = place.read_bytes()
        first, last = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
        if first >= len(data):
            self.send_error(416)
            return
        part = data[first : last + 1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {first}-{first + len(part) - 1}/{len(data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *_):
        pass


@query(f"SELECT n_nationkey, linear_index, v FROM ({FILE_TILES}) WHERE linear_index >= 4")
def remote_read(spark, sf_dir):
    """The lower tiles of files behind an HTTP server that answers ranges."""
    folder = _nation_files(spark, sf_dir, compression="LZW")
    server = ThreadingHTTPServer(("0.0.0.0", 0), partial(_Ranges, directory=folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    urls = ",".join(f"http://{host}:{server.server_port}/{r[0]}.img" for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    return api.read_tiles(spark, urls).where("tile_row = 1").select(_number(), "linear_index", _first())


@query(
    "SELECT n_nationkey, '{\"width\":100,\"height\":60,\"pixel_type\":\"UInt8\",\"channel_count\":1,\"tile_w\":32,\"tile_h\":32,\"tile_cols\":4,\"tile_rows\":2,\"compression\":\"None\",\"predictor\":\"none\",\"is_bigtiff\":false}' AS info, CAST(8 AS BIGINT) AS tiles,"
    " '{\"fields\":{\"image.spice.frame\":\"' || n_name || '\"}}' AS metadata FROM nation"
)
def file_info(spark, sf_dir):
    """What a command line prints of a file."""
    images = api.read_images(spark, f"{_nation_files(spark, sf_dir)}/*.img")
    keys = ["path", "image_index"]
    joined = api.info(images).withColumnRenamed("json", "info").join(api.tile_list(images), keys).join(api.metadata(images).withColumnRenamed("json", "metadata"), keys)
    return joined.select(_number(), "info", "tiles", "metadata")


# Of a sample type: a value, and the bytes of one sample of it.
CONSTANTS = [("UInt8", "7.9", "07"), ("Int16", "-3.7", "FDFF"), ("UInt16", "300.2", "2C01"), ("Int32", "-1.0", "FFFFFFFF"), ("UInt32", "65536.0", "00000100"), ("Float32", "1.5", "0000C03F"), ("Float64", "-2.0", "00000000000000C0")]


@query(
    f"SELECT pt AS pixel_type, CAST(i % 3 AS BIGINT) AS tile_col, CAST(i // 3 AS BIGINT) AS tile_row, repeat(b, 3) AS start, CAST(length(b) // 2 * 16 * 16 * 3 AS BIGINT) AS n_bytes FROM ({_values(CONSTANTS, 'pt, v, b')}), range(6) AS r(i)"
)
def constant_images(spark, sf_dir):
    """Images of one value in three channels; a value is cut to a whole number for integer samples."""
    out = None
    for kind, value, _ in CONSTANTS:
        rows = api.constant_image(spark, "x", 40, 20, float(value), kind, 3, 16)
        rows = rows.select("pixel_type", "tile_col", "tile_row", F.hex(F.expr(f"substr(data, 1, {3 * samples.TYPES[kind][0]})")).alias("start"), F.length("data").cast("bigint").alias("n_bytes"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_values([(c, r, 10 if (c, r) == (1, 0) else 7) for c in range(3) for r in range(2)], "tile_col, tile_row, v"))
def interactive_sink(spark, sf_dir):
    """An image that is filled, written tile by tile, closed and read again."""
    path = f"{views.scratch(spark)}/a.img"
    sink = api.Sink(spark, path, 40, 20, tile=16, compression="LZW")
    sink.fill(7.9)
    sink.write_tile(1, 0, "0a" * 256)
    sink.close()
    return api.read_tiles(spark, path).select(F.col("tile_col").cast("int").alias("tile_col"), F.col("tile_row").cast("int").alias("tile_row"), _first().cast("int").alias("v"))

"""Files: round trips, damage, pushdown, ranges over HTTP, streams."""

import http.server
import random
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import api
from tesserae.errors import InvalidArgument, NotFound, NotImplementedYet, OutOfRange
from tesserae.functions import canonical, codecs, payload, samples
from tesserae.sources import containers, datasource, tiff
from tesserae.sources.ranged import Ranged


def noise(n, seed=0):
    return np.random.default_rng(seed).integers(0, 7, n, dtype=np.uint8).tobytes()


def image_file(big=None, tiled=True, compression="LZW", predictor=2, kind="UInt8", channels=1, n=2):
    images = [tiff.Image(50, 37, kind, channels, 16 if tiled else 50, 16, compression, predictor, tiled=tiled, fields={"image.spice.frame": "IAU_MOON", "other.a": "b"}) for _ in range(n)]
    tiles = [[noise(i.tile_bytes(r), r * 7 + c) for r in range(i.rows) for c in range(i.cols)] for i in images]
    return images, tiles, tiff.write(images, tiles, "image", big)


@pytest.mark.parametrize("codec", ["LZW", "PackBits", "Deflate", "Zstd", "Zlib", "None"])
def test_codecs(codec):
    rng = random.Random(2)
    for n in (1, 2, 300, 40_000):
        for k in (2, 5, 256):
            data = bytes(rng.randrange(k) for _ in range(n))
            packed = codecs.ENCODERS[codec](data)
            assert codecs.DECODERS[codec](packed, n) == data
            with pytest.raises(InvalidArgument):
                codecs.DECODERS[codec](packed, n + 1)


def test_lzw_of_the_standard():
    """The example of the TIFF standard."""
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    packed = codecs.lzw_encode(data)
    bits = "".join(f"{b:08b}" for b in packed)
    assert [int(bits[i : i + 9], 2) for i in range(0, 81, 9)] == [256, 7, 258, 8, 8, 258, 6, 6, 257]


def test_packbits_of_the_standard():
    data = bytes.fromhex("AAAAAA80002A" + "AA" * 4 + "80002A22" + "AA" * 10)
    assert codecs.packbits_encode(data) == bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert codecs.packbits_decode(bytes.fromhex("80FEAA"), 3) == b"\xaa" * 3


def waves(h, w, c):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([127 + 100 * np.sin((x * (i + 1) + y * 2) / 17) for i in range(c)], -1).astype(np.uint8)


@pytest.mark.parametrize("shape", [(16, 16, 1), (33, 50, 3), (1, 1, 1), (64, 8, 3)])
def test_jpeg_against_the_jvm(spark, shape):
    """What is written is read by the JVM's own reader, and what that writes is read here; both agree with the samples."""
    h, w, c = shape
    a = waves(h, w, c)
    packed = codecs.encode_tile(a.tobytes(), "Jpeg", 1, w, c, "UInt8")
    own = np.frombuffer(codecs.decode_tile(packed, a.size, "Jpeg", 1, w, c, "UInt8"), np.uint8).reshape(a.shape)
    assert abs(own.astype(int) - a).max() <= 12
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(packed))
    assert (image.getWidth(), image.getHeight()) == (w, h)
    for y in range(0, h, 5):
        for x in range(0, w, 7):
            rgb = image.getRaster().getSample(x, y, 0) if c == 1 else image.getRGB(x, y) >> 16 & 255
            assert abs(rgb - int(own[y, x, 0])) <= 2
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    again = np.frombuffer(codecs.decode_tile(bytes(out.toByteArray()), a.size, "Jpeg", 1, w, c, "UInt8"), np.uint8).reshape(a.shape)
    assert abs(again.astype(int) - a).mean() < 8


def test_jpeg_refuses():
    good = codecs.encode_tile(waves(16, 16, 1).tobytes(), "Jpeg", 1, 16, 1, "UInt8")
    for args in ((good, 256, "Jpeg", 1, 8, 1, "UInt8"), (good, 768, "Jpeg", 1, 16, 3, "UInt8"), (good, 256, "Jpeg", 2, 16, 1, "UInt8"), (good, 512, "Jpeg", 1, 16, 1, "UInt16"), (b"", 256, "Jpeg", 1, 16, 1, "UInt8"), (good[:60], 256, "Jpeg", 1, 16, 1, "UInt8"), (good[:-30], 256, "Jpeg", 1, 16, 1, "UInt8")):
        with pytest.raises(InvalidArgument):
            codecs.decode_tile(*args)


@pytest.mark.parametrize("kind", [k for k in samples.TYPES if not k.startswith("Float")])
@pytest.mark.parametrize("little", [True, False])
def test_predictor(kind, little):
    a = np.random.default_rng(1).integers(0, 250, (6, 5, 3)).astype(samples.dtype(kind, little))
    a[0, 0, 0], a[0, 1, 0] = np.iinfo(a.dtype).min, np.iinfo(a.dtype).max
    packed = codecs.predict(a.tobytes(), 5, 3, kind, little)
    assert codecs.unpredict(packed, 5, 3, kind, little) == a.tobytes()
    with pytest.raises(InvalidArgument):
        codecs.predict(b"\0" * 8, 1, 1, "Float64")


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("compression,predictor,kind,channels", [("None", 1, "Float64", 2), ("LZW", 2, "Int16", 3), ("Deflate", 2, "UInt32", 6), ("PackBits", 1, "UInt8", 1)])
def test_tiff_round_trip(big, tiled, compression, predictor, kind, channels):
    images, tiles, data = image_file(big, tiled, compression, predictor, kind, channels)
    read = lambda at, n: data[at : at + n]
    found = tiff.images(read)
    assert len(found) == 2
    for image, own, got in zip(images, tiles, found, strict=True):
        assert (got.width, got.height, got.pixel_type, got.channels, got.big, got.fields) == (50, 37, kind, channels, big, {"image.spice.frame": "IAU_MOON"})
        assert [tiff.read_tile(read, got, i % image.cols, i // image.cols) for i in range(len(own))] == own
    with pytest.raises(OutOfRange):
        tiff.read_tile(read, found[0], 99, 0)


def test_damaged_files():
    _, _, data = image_file()
    for bad in (b"", b"XX*\0", data[:6], b"II\x2b\0\x07\0\0\0" + data[8:], data[:20], b"II*\0" + struct.pack("<I", len(data) + 5) + data[8:]):
        with pytest.raises((InvalidArgument, NotFound)):
            tiff.images(lambda at, n, d=bad: d[at : at + n])
    for at in range(0, 200):
        bad = data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :]
        try:
            tiff.images(lambda at, n, d=bad: d[at : at + n])
        except (InvalidArgument, NotFound):
            pass


def test_payload():
    data = payload.encode({"image.b": "2", "image.a": "é"}, "image")
    assert data[:5] == b"IMAGE" and payload.decode(data) == ("image", {"image.a": "é", "image.b": "2"})
    for n in range(len(data)):
        with pytest.raises(InvalidArgument):
            payload.decode(data[:n])


@pytest.mark.parametrize("kind", ["raw", "pds4", "isis", "chunked", "exr"])
@pytest.mark.parametrize("channels", [1, 3])
def test_containers(kind, channels):
    tile = (20, 12) if kind == "exr" else (8, 8)
    fields = {"imageWidth": "20", "imageHeight": "12", "tileWidth": str(tile[0]), "tileHeight": str(tile[1]), "samplesPerPixel": str(channels), "pixelType": "Float32", "compression": "zstd" if kind == "chunked" else "None"}
    size = tile[0] * tile[1] * channels * 4
    tiles = [noise(size, i) for i in range(1 if kind == "exr" else 6)]
    data = containers.write(kind, fields, tiles)
    (image,) = containers.parse(kind, data)
    assert (image.width, image.height, image.channels, image.pixel_type) == (20, 12, channels, "Float32")
    assert [containers.tile(kind, lambda at, n: data[at : at + n], image, i % image.cols, i // image.cols) for i in range(len(tiles))] == tiles
    with pytest.raises(InvalidArgument):
        containers.parse(kind, b"\0" * 7)


@pytest.mark.parametrize("compression", ["RLE", "ZIPS", "ZIP"])
def test_compressed_openexr(compression):
    """Blocks packed as the format says: bytes of even and odd places apart, differences plus 128, then runs or zlib."""
    import zlib

    fields = {"imageWidth": "20", "imageHeight": "37", "samplesPerPixel": "3", "pixelType": "Float32"}
    data = noise(20 * 37 * 12, 3)
    plain = containers.write("exr", fields, [data])
    code, lines = {"RLE": (1, 1), "ZIPS": (2, 1), "ZIP": (3, 16)}[compression]
    head, n = plain[: -(37 * (8 + 240) + 37 * 8)], -(-37 // lines)
    head = head.replace(b"compression\0compression\0\1\0\0\0\0", b"compression\0compression\0\1\0\0\0" + bytes([code]))
    rows = [plain[len(plain) - 37 * 248 + y * 248 + 8 :][:240] for y in range(37)]
    blocks = []
    for at in range(0, 37, lines):
        raw = b"".join(rows[at : at + lines])
        split = raw[0::2] + raw[1::2]
        delta = bytes([split[0], *((split[i] - split[i - 1] + 128) % 256 for i in range(1, len(split)))])
        packed = zlib.compress(delta) if code > 1 else b"".join(struct.pack("b", -len(delta[i : i + 100])) + delta[i : i + 100] for i in range(0, len(delta), 100))
        blocks.append((at, packed if len(packed) < len(raw) else raw))
    offsets, place = [], len(head) + 8 * n
    for _, b in blocks:
        offsets.append(place)
        place += 8 + len(b)
    whole = head + struct.pack(f"<{n}Q", *offsets) + b"".join(struct.pack("<ii", y, len(b)) + b for y, b in blocks)
    read = lambda at, k: whole[at : at + k]
    (image,) = containers.parse("exr", whole)
    assert image.compression == compression and containers.exr_bytes(image) == len(data)
    assert containers.tile("exr", read, image, 0, 0) == data


def test_canonical_json():
    cases = {0.0: "0", -0.0: "0", 1.0: "1", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7", 123.456: "123.456", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", -2.5e-10: "-2.5e-10", 333333333.3333333: "333333333.3333333"}
    for x, s in cases.items():
        assert canonical.number(x) == s
    assert canonical.text({"\U0001f600": 1, "דּ": 2, "a": [None, True, 'q"\n\x01']}) == '{"a":[null,true,"q\\"\\n\\u0001"],"\U0001f600":1,"דּ":2}'
    assert canonical.integer(1 << 53) == 1 << 53 and canonical.integer((1 << 53) + 1) == str((1 << 53) + 1)
    with pytest.raises(NotImplementedYet):
        canonical.number(float("nan"))


def test_source_and_pushdown(spark, tmp_path):
    _, tiles, data = image_file()
    (tmp_path / "a.tif").write_bytes(data)
    datasource.register(spark)
    path = str(tmp_path / "*.tif")
    images = spark.read.format("raster").load(path)
    assert [(r.image_index, r.width, r.tile_cols, r.tile_rows, r.fields) for r in images.orderBy("image_index").collect()] == [(i, 50, 4, 3, {"image.spice.frame": "IAU_MOON"}) for i in (0, 1)]
    rows = spark.read.format("raster").option("table", "tiles").option("partition_bytes", 600).load(path)
    got = rows.orderBy("image_index", "linear_index").collect()
    assert [bytes(r.data) for r in got] == tiles[0] + tiles[1]
    one = rows.where("image_index = 1 and tile_col = 2 and tile_row = 1").collect()
    assert len(one) == 1 and bytes(one[0].data) == tiles[1][6]
    tags = spark.read.format("raster").option("table", "tags").load(path)
    assert {int(r["values"][0]) for r in tags.where("tag = 256").collect()} == {50}
    assert sorted(map(str, datasource.images_of(spark, path).drop("path").collect())) == sorted(map(str, images.drop("path").collect()))
    for held in (datasource.tiles_of(spark, path), api.read_tiles(spark, path)):
        assert datasource.pixels(held).count() == 2 * 50 * 37
    pixels = api.read_pixels(spark, path)
    first = np.frombuffer(tiles[0][0], np.uint8).reshape(16, 16)
    assert pixels.where("image_index = 0 and x = 5 and y = 9").first().value == first[9, 5]


def test_planning_opens_no_file_and_a_tile_reads_only_its_bytes(spark, tmp_path, monkeypatch):
    images = [tiff.Image(512, 512, "UInt8", 1, 64, 64)]
    (tmp_path / "a.tif").write_bytes(tiff.write(images, [[noise(4096, i) for i in range(64)]]))
    reader = datasource.RasterReader({"path": str(tmp_path / "a.tif"), "table": "tiles", "partition_bytes": "65536"})
    opened, read = [], []
    monkeypatch.setattr(datasource.RasterReader, "_open", lambda self, path: opened.append(path) or Ranged(path))
    parts = reader.partitions()
    assert not opened and len(parts) == 5
    assert sorted(r[5] for p in parts for r in reader.read(p)) == list(range(64))
    from pyspark.sql.datasource import EqualTo

    list(reader.pushFilters([EqualTo(("tile_col",), 3), EqualTo(("tile_row",), 2)]))
    (part,) = reader.partitions()
    own = Ranged.read
    monkeypatch.setattr(Ranged, "read", lambda self, at, n: read.append(n) or own(self, at, n))
    (row,) = reader.read(part)
    assert row[5] == 19 and bytes(row[14]) == noise(4096, 19)
    assert sum(read) < 4096 + 2048


@pytest.mark.parametrize("kind", ["raw", "pds4", "isis", "chunked", "exr"])
def test_sinks_of_all_containers(spark, tmp_path, kind):
    size = 32 if kind == "exr" else 16
    sink = api.Sink(spark, str(tmp_path / "a.img"), 32, 32, "Float32", 1, size, container=kind)
    tiles = {(c, r): noise(size * size * 4, c * 7 + r) for c in range(32 // size) for r in range(32 // size)}
    for (c, r), data in tiles.items():
        sink.write_tile(c, r, data)
    sink.close()
    got = api.read_tiles(spark, str(tmp_path / "a.img"), kind).collect()
    assert {(r.tile_col, r.tile_row): bytes(r.data) for r in got} == tiles


def test_interactive_sink(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    sink = api.Sink(spark, path, 40, 20, tile=16, fields={"image.spice.frame": "IAU_MARS"}, compression="LZW")
    sink.fill(7.9)
    sink.write_tile(1, 0, "0a" * 256)
    with pytest.raises(OutOfRange):
        sink.write_tile(3, 0, b"")
    with pytest.raises(InvalidArgument):
        sink.write_tile(0, 0, b"short")
    assert sink.info()["tiles"] == 6 and sink.info()["open"]
    sink.close()
    sink.close()
    assert not sink.info()["open"]
    assert api.tile(spark, path, 0, 1, 0).tolist() == [[[10]] * 16] * 16 and api.tile(spark, path, 0, 0, 1)[0, 0, 0] == 7
    assert len(api.image_bytes(spark, path)) == 6 * 256
    image = api.read_images(spark, path).first()
    assert (image.width, image.height, image.compression, image.fields) == (40, 20, "LZW", {"image.spice.frame": "IAU_MARS"})
    assert api.size_bytes(path) == (tmp_path / "a.tif").stat().st_size
    api.write_thumbnail(spark, path, str(tmp_path / "small.tif"), 4, 2)
    assert api.tile(spark, str(tmp_path / "small.tif"), 0, 0, 0)[:, :, 0].tolist() == [[7, 7 if 10 < 16 else 10, 10, 10 if 30 < 32 else 7], [7, 7, 10, 10]]


def test_failed_task_leaves_no_file(spark, tmp_path):
    (tmp_path / "out").mkdir()
    rows = api.constant_image(spark, str(tmp_path / "out" / "a.tif"), 40, 20, 1, tile=16).withColumn("data", F.expr("if(linear_index = 4, substr(data, 1, 3), data)"))
    good = api.constant_image(spark, str(tmp_path / "out" / "b.tif"), 40, 20, 1, tile=16)
    with pytest.raises(Exception, match="tile size"):
        api.write(good.unionByName(rows))
    assert not list((tmp_path / "out").iterdir())
    writer = datasource.RasterWriter({})
    messages = [writer.write(iter(good.collect())), writer.write(iter(good.collect()))]
    assert len(list((tmp_path / "out").iterdir())) == 2
    writer.abort(messages)
    assert not list((tmp_path / "out").iterdir())


def test_sink_and_copy(spark, tmp_path):
    _, tiles, data = image_file(n=2)
    (tmp_path / "a.tif").write_bytes(data)
    (tmp_path / "out").mkdir()
    api.copy(spark, str(tmp_path / "a.tif"), str(tmp_path / "out"), compression="Deflate")
    again = (tmp_path / "out" / "a.tif").read_bytes()
    images = tiff.images(lambda at, n: again[at : at + n])
    assert [(i.width, i.height, i.compression, i.predictor, i.fields) for i in images] == [(50, 37, "Deflate", 2, {"image.spice.frame": "IAU_MOON"})] * 2
    for image, own in zip(images, tiles, strict=True):
        assert [tiff.read_tile(lambda at, n: again[at : at + n], image, i % 4, i // 4) for i in range(12)] == own


def test_offsets_of_streams_go_by_time(tmp_path):
    import os

    stream = datasource.RasterStream({"path": str(tmp_path / "*.tif")})
    assert stream.latestOffset() == stream.initialOffset()
    seen, start = [], stream.initialOffset()
    for at, name in enumerate(["m.tif", "b.tif", "z.tif", "a.tif"]):
        (tmp_path / name).write_bytes(b"")
        os.utime(tmp_path / name, ns=(at * 10**9, at * 10**9 + 1))
        end = stream.latestOffset()
        seen += [p.path.rsplit("/", 1)[1] for p in stream.partitions(start, end)]
        start = end
    assert seen == ["m.tif", "b.tif", "z.tif", "a.tif"]


def test_stream_of_new_files(spark, tmp_path):
    _, _, data = image_file(n=1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(data)
    datasource.register(spark)
    stream = spark.readStream.format("raster").load(str(tmp_path / "in" / "*.tif"))
    query = stream.select("path", "width").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.tif").write_bytes(data)
    query.processAllAvailable()
    query.stop()
    assert spark.table("arrived").select(F.element_at(F.split("path", "/"), -1).alias("n"), "width").orderBy("n").collect() == [("a.tif", 50), ("b.tif", 50)]


class Server(http.server.BaseHTTPRequestHandler):
    data, ranges = b"", True

    def do_GET(self):
        if self.path == "/none":
            self.send_error(404)
            return
        data, at = self.data, self.headers.get("Range")
        if self.ranges and at:
            a, b = map(int, at.removeprefix("bytes=").split("-"))
            if a >= len(data):
                self.send_error(416)
                return
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{min(b, len(data) - 1)}/{len(data)}")
            data = data[a : b + 1]
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.mark.parametrize("ranges", [True, False])
def test_ranges_over_http(ranges):
    _, tiles, data = image_file()
    kind = type("Own", (Server,), {"data": data, "ranges": ranges})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), kind)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    with Ranged(url + "/x", window=64) as f:
        found = tiff.images(f.read)
        assert f.size == len(data)
        assert tiff.read_tile(f.read, found[1], 2, 1) == tiles[1][6]
        assert f.read(len(data) + 10, 5) == b""
    with pytest.raises(NotFound):
        Ranged(url + "/none")
    server.shutdown()


def test_missing_path():
    with pytest.raises(NotFound):
        Ranged("/no/such/file.tif")

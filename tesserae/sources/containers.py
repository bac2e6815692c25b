"""Other image files: raw tiles behind a label. Each kind parses its label to fields and knows where its tiles lie.

raw      a JSON document of fields (or a list of them), then the tiles
pds4     u64 length, an XML label, then the tiles
isis     a text label up to a line "End", then the tiles
chunked  u64 length, a JSON header, then slots of equal size: u32 length and the compressed chunk
exr      an OpenEXR scan-line file, read as it is, by runs or by ZIP, written as it is; the whole image is one tile
"""

from __future__ import annotations

import json
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from xml.sax.saxutils import escape

import numpy as np

from tesserae.errors import InvalidArgument, NotImplementedYet, OutOfRange
from tesserae.functions import codecs, samples

MAX_LABEL = 16 << 20
MAX_TEXT_LABEL = 4 << 20
# Names of sample types in labels.
ISIS_TYPES = {"UInt8": "UnsignedByte", "UInt16": "UnsignedWord", "UInt32": "UnsignedInteger", "Float32": "Real", "Float64": "Double"}
CHUNK_TYPES = {"UInt8": "|u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8"}
CHUNK_CODECS = {"none": "None", "zstd": "Zstd", "zlib": "Zlib"}
EXTRA_KEYS = ("tileWidth", "tileHeight", "predictor", "container")
EXR_TYPES = {0: "UInt32", 2: "Float32"}
EXR_COMPRESSIONS = {0: "None", 1: "RLE", 2: "ZIPS", 3: "ZIP"}
EXR_LINES = {"None": 1, "RLE": 1, "ZIPS": 1, "ZIP": 16}  # in a block


@dataclass
class Layout:
    """An image, where its tiles begin and how far apart they are."""

    fields: dict[str, str]
    width: int
    height: int
    channels: int
    pixel_type: str
    tile_w: int
    tile_h: int
    start: int
    compression: str = "None"
    slot: int = 0

    @property
    def cols(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def rows(self) -> int:
        return -(-self.height // self.tile_h)

    @property
    def tile_bytes(self) -> int:
        return self.tile_w * self.tile_h * self.channels * samples.TYPES[self.pixel_type][0]

    @property
    def bytes(self) -> int:
        return self.cols * self.rows * (self.slot or self.tile_bytes)


def layout(fields: dict[str, str], start: int) -> Layout:
    try:
        w, h, c = int(fields["imageWidth"]), int(fields["imageHeight"]), int(fields.get("samplesPerPixel", 1))
        kind = fields.get("pixelType", "UInt8")
        tw, th = int(fields.get("tileWidth", 0)) or w, int(fields.get("tileHeight", 0)) or h
    except (KeyError, ValueError) as e:
        raise InvalidArgument(f"image fields: {e}") from None
    if kind not in samples.TYPES or min(w, h, c, tw, th) < 1:
        raise InvalidArgument("image fields")
    return Layout(fields, w, h, c, kind, tw, th, start)


def _prefixed(data: bytes) -> tuple[bytes, int]:
    if len(data) < 8:
        raise InvalidArgument("label is cut off")
    (size,) = struct.unpack_from("<Q", data)
    if size > MAX_LABEL or 8 + size > len(data):
        raise InvalidArgument("label size")
    return data[8 : 8 + size], 8 + size


def parse_raw(data: bytes) -> list[Layout]:
    text = data.decode("utf-8", "surrogateescape")
    try:
        found, end = json.JSONDecoder().raw_decode(text)
    except ValueError as e:
        raise InvalidArgument(f"raw label: {e}") from None
    found = found if isinstance(found, list) else found.get("children", [found])
    at, out = len(text[:end].encode("utf-8", "surrogateescape")), []
    for one in found:
        out.append(layout({k: str(v) for k, v in one.get("fields", one).items()}, at))
        at += out[-1].bytes
    return out


def parse_pds4(data: bytes) -> list[Layout]:
    label, start = _prefixed(data)
    try:
        root = ET.fromstring(label.decode("utf-8"))
    except (ET.ParseError, UnicodeDecodeError) as e:
        raise InvalidArgument(f"XML label: {e}") from None
    array = root.find("Array_2D_Image")
    if root.tag != "Product_Observational" or array is None:
        raise InvalidArgument("XML label without an image array")
    return [layout({e.tag: e.text or "" for e in array}, start)]


def assignments(label: str) -> dict[str, str]:
    """key = value lines; quotes are taken off, the last of equal keys wins."""
    out = {}
    for line in label.split("\n"):
        key, found, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if found and key:
            out[key] = value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value
    return out


def parse_isis(data: bytes) -> list[Layout]:
    end = data[:MAX_TEXT_LABEL].rfind(b"\nEnd\n")
    if end < 0:
        raise InvalidArgument("text label without an end")
    label = data[:end].decode("utf-8")
    if "Object = IsisCube" not in label:
        raise InvalidArgument("no cube label")
    kv = assignments(label)
    back = {v: k for k, v in ISIS_TYPES.items()}
    if kv.get("Type") not in back or not {"Samples", "Lines", "Bands"} <= kv.keys():
        raise InvalidArgument("cube label lacks dimensions or a known type")
    fields = {"imageWidth": kv["Samples"], "imageHeight": kv["Lines"], "samplesPerPixel": kv["Bands"], "pixelType": back[kv["Type"]], "compression": kv.get("Compression", "None")}
    return [layout(fields | {k: kv[k] for k in EXTRA_KEYS if k in kv}, end + 5)]


def parse_chunked(data: bytes) -> list[Layout]:
    header, start = _prefixed(data)
    try:
        j = json.loads(header)
        shape, (th, tw), kind, codec = j["shape"], j["chunks"], j["dtype"], CHUNK_CODECS[j.get("compressor", "none")]
        pixel_type = {v: k for k, v in CHUNK_TYPES.items()}[kind]
        c, h, w = [1, *shape] if len(shape) == 2 else shape
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidArgument(f"chunked header: {e}") from None
    out = Layout({"imageWidth": str(w), "imageHeight": str(h), "samplesPerPixel": str(c), "pixelType": pixel_type, "compression": codec}, w, h, c, pixel_type, tw, th, start, codec)
    out.slot = 4 + codecs.payload_bound(codec, out.tile_bytes)
    return [out]


def parse_exr(data: bytes) -> list[Layout]:
    if data[:4] != b"\x76\x2f\x31\x01":
        raise InvalidArgument("no OpenEXR magic")
    at, attributes = 8, {}
    while data[at] != 0:
        name, kind = data[at:].split(b"\0", 2)[:2]
        at += len(name) + len(kind) + 2
        (size,) = struct.unpack_from("<i", data, at)
        attributes[name.decode()] = data[at + 4 : at + 4 + size]
        at += 4 + size
    compression = EXR_COMPRESSIONS.get(attributes["compression"][0])
    if compression is None:
        raise NotImplementedYet("OpenEXR compression other than runs and ZIP")
    x0, y0, x1, y1 = struct.unpack("<4i", attributes["dataWindow"])
    names, kinds, rest = [], [], attributes["channels"]
    while rest[:1] not in (b"", b"\0"):
        name, _, rest = rest.partition(b"\0")
        names.append(name.decode())
        kinds.append(struct.unpack_from("<i", rest)[0])
        rest = rest[16:]
    if len(set(kinds)) != 1 or kinds[0] not in EXR_TYPES:
        raise InvalidArgument("OpenEXR channel types")
    w, h = x1 - x0 + 1, y1 - y0 + 1
    fields = {"imageWidth": str(w), "imageHeight": str(h), "samplesPerPixel": str(len(names)), "pixelType": EXR_TYPES[kinds[0]], "channels": ",".join(names), "compression": compression}
    return [Layout(fields, w, h, len(names), EXR_TYPES[kinds[0]], w, h, at + 1, compression)]


PARSERS = {"raw": parse_raw, "pds4": parse_pds4, "isis": parse_isis, "chunked": parse_chunked, "exr": parse_exr}


def parse(kind: str, data: bytes) -> list[Layout]:
    if kind not in PARSERS:
        raise InvalidArgument(f"container {kind}")
    return PARSERS[kind](data)


def _channel_order(names: list[str]) -> list[int]:
    """Places, in a file's alphabetical channels, of R, G, B, A."""
    wanted = [c for c in "RGBA" if c in names] or names
    return [names.index(c) for c in wanted]


def tile(kind: str, read: Callable[[int, int], bytes], image: Layout, col: int, row: int) -> bytes:
    """A tile's samples, interleaved; only its bytes are read."""
    if not (0 <= col < image.cols and 0 <= row < image.rows):
        raise OutOfRange("tile index")
    if kind == "exr":
        return _exr_pixels(read, image)
    at = image.start + (row * image.cols + col) * (image.slot or image.tile_bytes)
    if image.slot:
        (size,) = struct.unpack("<I", read(at, 4))
        return codecs.DECODERS[image.compression](read(at + 4, size), image.tile_bytes)
    out = read(at, image.tile_bytes)
    if len(out) != image.tile_bytes:
        raise InvalidArgument("tile outside the file")
    return out


def _exr_pixels(read: Callable[[int, int], bytes], image: Layout) -> bytes:
    """Blocks of one or more lines, found by the offset table; a line holds its channels one after the other."""
    stride, lines = image.width * image.channels * 4, EXR_LINES[image.compression]
    blocks = -(-image.height // lines)
    offsets = struct.unpack(f"<{blocks}Q", read(image.start, 8 * blocks))
    out = []
    for i, at in enumerate(offsets):
        _, size = struct.unpack("<ii", read(at, 8))
        data, whole = read(at + 8, size), min(lines, image.height - i * lines) * stride
        if len(data) != size:
            raise InvalidArgument("OpenEXR block outside the file")
        # A block that does not shrink is stored as it is.
        out.append(data if size == whole else _exr_unpack(image.compression, data, whole))
    planes = np.frombuffer(b"".join(out), "<u4").reshape(image.height, image.channels, image.width)
    return planes[:, _channel_order(image.fields["channels"].split(","))].transpose(0, 2, 1).tobytes()


def _exr_unpack(compression: str, data: bytes, size: int) -> bytes:
    """Bytes of even and of odd places lie apart, as differences to the byte before plus 128."""
    raw = np.frombuffer(_exr_runs(data, size) if compression == "RLE" else codecs.DECODERS["Zlib"](data, size), np.uint8)
    if len(raw) != size:
        raise InvalidArgument("OpenEXR block of another size")
    whole = (np.cumsum(raw.astype(np.int64)) - 128 * np.arange(size)).astype(np.uint8)
    out = np.empty(size, np.uint8)
    out[0::2], out[1::2] = whole[: (size + 1) // 2], whole[(size + 1) // 2 :]
    return out.tobytes()


def _exr_runs(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        (n,) = struct.unpack_from("b", data, at)
        if n < 0:
            out += data[at + 1 : at + 1 - n]
            at += 1 - n
        else:
            out += data[at + 1 : at + 2] * (n + 1)
            at += 2
    if len(out) != size:
        raise InvalidArgument("OpenEXR runs of another size")
    return bytes(out)


def exr_bytes(image: Layout) -> int:
    """All samples of an image; more than 2 ** 63 is an error."""
    n = image.width * image.height * image.channels * 4
    if n >= 1 << 63:
        raise InvalidArgument("OpenEXR image too large")
    return n


def fields_of(image) -> dict[str, str]:
    """The fields that a label needs, of an image with sizes; its own fields stay where a label can hold them."""
    return {k: v for k, v in image.fields.items() if k.isidentifier()} | {
        "imageWidth": str(image.width), "imageHeight": str(image.height), "samplesPerPixel": str(image.channels), "pixelType": image.pixel_type,
        "tileWidth": str(image.tile_w), "tileHeight": str(image.tile_h), "compression": image.compression,
    }


def write(kind: str, fields: dict[str, str], tiles: Iterable[bytes]) -> bytes:
    """A file of one image; tiles are samples in row-major order of tiles."""
    image = layout(fields, 0)
    tiles = list(tiles)
    if kind != "exr" and any(len(t) != image.tile_bytes for t in tiles):
        raise InvalidArgument("tile size")
    if kind == "raw":
        return b"".join([json.dumps({"fields": fields}).encode(), *tiles])
    if kind == "pds4":
        label = "<Product_Observational><Array_2D_Image>" + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in sorted(fields.items())) + "</Array_2D_Image></Product_Observational>"
        return b"".join([struct.pack("<Q", len(label.encode())), label.encode(), *tiles])
    if kind == "isis":
        if image.pixel_type not in ISIS_TYPES:
            raise InvalidArgument("sample type of a cube")
        lines = ["Object = IsisCube", "  Object = Core", "    Group = Dimensions", f"      Samples = {image.width}", f"      Lines = {image.height}", f"      Bands = {image.channels}", "    End_Group"]
        lines += ["    Group = Pixels", f"      Type = {ISIS_TYPES[image.pixel_type]}", "      ByteOrder = Lsb", f'      Compression = "{fields.get("compression", "None")}"', "    End_Group"]
        lines += [f'          {k} = "{fields[k]}"' for k in EXTRA_KEYS if k in fields] + ["  End_Object", "End_Object", "End", ""]
        return b"".join(["\n".join(lines).encode(), *tiles])
    if kind == "chunked":
        codec = next((k for k, v in CHUNK_CODECS.items() if fields.get("compression", "None").lower() in (k, v.lower())), None)
        if codec is None or image.pixel_type not in CHUNK_TYPES:
            raise InvalidArgument("codec or sample type of chunks")
        name = CHUNK_CODECS[codec]
        shape = [image.height, image.width] if image.channels == 1 else [image.channels, image.height, image.width]
        header = json.dumps({"chunks": [image.tile_h, image.tile_w], "compressor": codec, "dtype": CHUNK_TYPES[image.pixel_type], "shape": shape}, separators=(",", ":")).encode()
        slot = codecs.payload_bound(name, image.tile_bytes)
        out = [struct.pack("<Q", len(header)), header]
        for t in tiles:
            packed = codecs.ENCODERS[name](t)
            out += [struct.pack("<I", len(packed)), packed.ljust(slot, b"\0")]
        return b"".join(out)
    if kind == "exr":
        return _write_exr(image, tiles[0])
    raise InvalidArgument(f"container {kind}")


def _write_exr(image: Layout, data: bytes) -> bytes:
    code = next((k for k, v in EXR_TYPES.items() if v == image.pixel_type), None)
    names = {1: "Y", 3: "RGB", 4: "RGBA"}.get(image.channels)
    if code is None or names is None:
        raise InvalidArgument("OpenEXR sample type or channels")
    order = sorted(names)
    attribute = lambda n, k, v: f"{n}\0{k}\0".encode() + struct.pack("<i", len(v)) + v
    box = struct.pack("<4i", 0, 0, image.width - 1, image.height - 1)
    channels = b"".join(n.encode() + b"\0" + struct.pack("<iB3xii", code, 0, 1, 1) for n in order) + b"\0"
    head = struct.pack("<II", 20000630, 2) + attribute("channels", "chlist", channels) + attribute("compression", "compression", b"\0") + attribute("dataWindow", "box2i", box) + attribute("displayWindow", "box2i", box)
    head += attribute("lineOrder", "lineOrder", b"\0") + attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + attribute("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)) + attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    planes = np.frombuffer(data, "<u4").reshape(image.height, image.width, image.channels)[:, :, [names.index(n) for n in order]].transpose(0, 2, 1)
    size = image.width * image.channels * 4
    first = len(head) + 8 * image.height
    offsets = struct.pack(f"<{image.height}Q", *(first + y * (8 + size) for y in range(image.height)))
    return b"".join([head, offsets, *(struct.pack("<ii", y, size) + planes[y].tobytes() for y in range(image.height))])

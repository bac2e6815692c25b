"""TIFF and BigTIFF files: directories, tiles and strips, and a writer that knows every offset before it writes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from tesserae.errors import InvalidArgument, NotFound, OutOfRange
from tesserae.functions import codecs, payload, samples

ReadAt = Callable[[int, int], bytes]  # offset and size to bytes; fewer at the end

# Tag numbers and field types of the TIFF standard, and the tags that hold metadata domains.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
DOMAIN_TAGS = {65001: "spice", 65002: "camera", 65003: "crs", 65004: "layers", 65005: "provenance"}
FIELD_SIZES = {1: 1, 3: 2, 4: 4, 16: 8}
MAX_DIRECTORIES, MAX_CHANNELS = 100_000, 512


@dataclass
class Image:
    """One directory. Untiled images are read as strips: tiles as wide as the image."""

    width: int
    height: int
    pixel_type: str
    channels: int
    tile_w: int
    tile_h: int
    compression: str = "None"
    predictor: int = 1
    little: bool = True
    big: bool = False
    tiled: bool = True
    ranges: list[tuple[int, int]] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)
    tags: dict[int, list[int]] = field(default_factory=dict)

    @property
    def cols(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def rows(self) -> int:
        return -(-self.height // self.tile_h)

    def tile_size(self, row: int) -> tuple[int, int]:
        """Width and height as stored: tiles are whole, the last strip is cut."""
        return self.tile_w, self.tile_h if self.tiled else min(self.tile_h, self.height - row * self.tile_h)

    def tile_bytes(self, row: int) -> int:
        w, h = self.tile_size(row)
        return w * h * self.channels * samples.TYPES[self.pixel_type][0]


def header(read: ReadAt) -> tuple[bool, bool, int]:
    """(little-endian, BigTIFF, offset of the first directory)."""
    h = read(0, 16)
    if len(h) < 8 or h[:2] not in (b"II", b"MM"):
        raise InvalidArgument("no TIFF header")
    little = h[:2] == b"II"
    end = "<" if little else ">"
    (magic,) = struct.unpack_from(end + "H", h, 2)
    if magic == 42:
        return little, False, struct.unpack_from(end + "I", h, 4)[0]
    if magic == 43 and len(h) == 16 and struct.unpack_from(end + "HH", h, 4) == (8, 0):
        return little, True, struct.unpack_from(end + "Q", h, 8)[0]
    raise InvalidArgument("unknown TIFF magic or offset size")


def directory(read: ReadAt, at: int, little: bool, big: bool) -> tuple[dict[int, list[int]], int]:
    """Tags and the next directory's offset. Field types that are not unsigned integers are passed over."""
    end = "<" if little else ">"
    count_form, entry, value_size, offset_form = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    width = struct.calcsize("=" + count_form)
    raw = read(at, width)
    if len(raw) < width:
        raise InvalidArgument("directory outside the file")
    (n,) = struct.unpack(end + count_form, raw)
    if n > 65_535:
        raise InvalidArgument("directory with too many entries")
    body = read(at + width, n * entry + value_size)
    if len(body) < n * entry + value_size:
        raise InvalidArgument("directory is cut off")
    tags: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind = struct.unpack_from(end + "HH", body, i * entry)
        (count,) = struct.unpack_from(end + offset_form, body, i * entry + 4)
        size = FIELD_SIZES.get(kind)
        if size is None:
            continue
        if count * size > 1 << 31:
            raise InvalidArgument("tag is too wide")
        place = i * entry + 4 + value_size
        if count * size <= value_size:
            data = body[place : place + count * size]
        else:
            data = read(struct.unpack_from(end + offset_form, body, place)[0], count * size)
        if len(data) < count * size:
            raise InvalidArgument("tag values outside the file")
        tags[tag] = list(struct.unpack(f"{end}{count}{ {1: 'B', 2: 'H', 4: 'I', 8: 'Q'}[size] }", data))
    return tags, struct.unpack_from(end + offset_form, body, n * entry)[0]


def tag(tags: dict[int, list[int]], number: int) -> list[int]:
    if number not in tags:
        raise NotFound(f"tag {number}")
    return tags[number]


def single(tags: dict[int, list[int]], number: int, default: int | None = None) -> int:
    """A tag's only value; several are an error, none the default."""
    if number not in tags and default is not None:
        return default
    values = tag(tags, number)
    if len(values) != 1:
        raise InvalidArgument(f"tag {number} has {len(values)} values")
    return values[0]


def interpret(tags: dict[int, list[int]], little: bool, big: bool) -> Image:
    width, height, channels = single(tags, WIDTH), single(tags, HEIGHT), single(tags, SAMPLES, 1)
    if not width or not height or not 1 <= channels <= MAX_CHANNELS:
        raise InvalidArgument("image size or channels")
    if single(tags, PLANAR, 1) != 1:
        raise InvalidArgument("only interleaved samples")
    bits = tag(tags, BITS)
    if len(set(bits)) != 1:
        raise InvalidArgument("channels of different sizes")
    pixel_type = samples.name_of(tags.get(SAMPLE_FORMAT, [1])[0], bits[0])
    if pixel_type is None:
        raise InvalidArgument("sample format")
    code = single(tags, COMPRESSION, 1)
    if code not in samples.TIFF_COMPRESSIONS:
        raise InvalidArgument(f"compression {code}")
    predictor = single(tags, PREDICTOR, 1)
    if predictor not in (1, 2) or predictor == 2 and pixel_type.startswith("Float"):
        raise InvalidArgument("predictor")
    tiled = TILE_W in tags
    if tiled:
        tile_w, tile_h, offsets, counts = single(tags, TILE_W), single(tags, TILE_H), tag(tags, TILE_OFFSETS), tag(tags, TILE_COUNTS)
    else:
        tile_w, tile_h, offsets, counts = width, min(single(tags, ROWS_PER_STRIP), height), tag(tags, STRIP_OFFSETS), tag(tags, STRIP_COUNTS)
    if not tile_w or not tile_h:
        raise InvalidArgument("tile size")
    image = Image(width, height, pixel_type, channels, tile_w, tile_h, samples.TIFF_COMPRESSIONS[code], predictor, little, big, tiled, list(zip(offsets, counts, strict=False)), {}, tags)
    if len(offsets) != image.cols * image.rows or len(counts) != len(offsets):
        raise InvalidArgument("number of tiles")
    for number in DOMAIN_TAGS:
        if number in tags:
            try:
                image.fields.update(payload.decode(bytes(tags[number]))[1])
            except (InvalidArgument, ValueError):
                continue  # a payload of someone else
    return image


def images(read: ReadAt) -> list[Image]:
    little, big, at = header(read)
    out = []
    while at:
        tags, following = directory(read, at, little, big)
        out.append(interpret(tags, little, big))
        if following and following <= at:
            raise InvalidArgument("directories must advance")
        if len(out) > MAX_DIRECTORIES:
            raise InvalidArgument("too many directories")
        at = following
    if not out:
        raise InvalidArgument("no directory")
    return out


def read_tile(read: ReadAt, image: Image, col: int, row: int) -> bytes:
    """A tile's samples, decoded, little-endian."""
    cols = image.cols
    if not (0 <= col < cols and 0 <= row < image.rows):
        raise OutOfRange("tile index")
    offset, count = image.ranges[row * cols + col]
    raw = read(offset, count)
    if len(raw) < count:
        raise InvalidArgument("tile outside the file")
    if image.compression == "None" and image.predictor == 1 and image.little:
        if count != image.tile_bytes(row):
            raise InvalidArgument("another size than the tile's")
        return raw
    w, _ = image.tile_size(row)
    out = codecs.decode_tile(raw, image.tile_bytes(row), image.compression, image.predictor, w, image.channels, image.pixel_type, image.little)
    if not image.little:
        kind = samples.dtype(image.pixel_type, False)
        out = codecs.np.frombuffer(out, kind).astype(kind.newbyteorder("<")).tobytes()
    return out


def _entries(image: Image, offsets: list[int], counts: list[int], namespace: str) -> list[tuple[int, int, list[int] | bytes]]:
    code = next(k for k, v in samples.TIFF_COMPRESSIONS.items() if v == image.compression)
    _, form, bits, _ = samples.TYPES[image.pixel_type]
    wide = 16 if image.big else 4
    out: list[tuple[int, int, list[int] | bytes]] = [
        (WIDTH, 4, [image.width]), (HEIGHT, 4, [image.height]), (BITS, 3, [bits] * image.channels), (COMPRESSION, 3, [code]),
        (PHOTOMETRIC, 3, [2 if image.channels == 3 else 1]), (SAMPLES, 3, [image.channels]), (PLANAR, 3, [1]), (SAMPLE_FORMAT, 3, [form] * image.channels),
    ]
    if image.predictor == 2:
        out.append((PREDICTOR, 3, [2]))
    if image.tiled:
        out += [(TILE_W, 4, [image.tile_w]), (TILE_H, 4, [image.tile_h]), (TILE_OFFSETS, wide, offsets), (TILE_COUNTS, wide, counts)]
    else:
        out += [(STRIP_OFFSETS, wide, offsets), (ROWS_PER_STRIP, 4, [image.tile_h]), (STRIP_COUNTS, wide, counts)]
    for number, domain in DOMAIN_TAGS.items():
        own = {k: v for k, v in image.fields.items() if k.startswith(f"{namespace}.{domain}.")}
        if own:
            out.append((number, 1, payload.encode(own, namespace)))
    return sorted(out, key=lambda e: e[0])


def _directory_size(entries: list, big: bool) -> int:
    fixed, entry, inline = (16, 20, 8) if big else (6, 12, 4)
    sizes = [len(v) * FIELD_SIZES[k] for _, k, v in entries]
    return fixed + entry * len(entries) + sum(s + s % 2 for s in sizes if s > inline)


def _directory_bytes(entries: list, at: int, following: int, big: bool) -> bytes:
    count_form, offset_form, entry, inline = ("<Q", "<Q", 20, 8) if big else ("<H", "<I", 12, 4)
    head = struct.calcsize(count_form) + entry * len(entries) + struct.calcsize(offset_form)
    table, tail = [struct.pack(count_form, len(entries))], []
    place = at + head
    for number, kind, values in entries:
        data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{ {1: 'B', 3: 'H', 4: 'I', 16: 'Q'}[kind] }", *values)
        table.append(struct.pack("<HH" + offset_form[1], number, kind, len(values)))
        if len(data) <= inline:
            table.append(data.ljust(inline, b"\0"))
        else:
            table.append(struct.pack(offset_form, place))
            data += b"\0" * (len(data) % 2)
            tail.append(data)
            place += len(data)
    return b"".join([*table, struct.pack(offset_form, following), *tail])


def plan(group: list[Image], counts: list[list[int]], namespace: str, big: bool | None = None) -> tuple[bytes, bool]:
    """Header and all directories; tiles follow in order. BigTIFF where 32-bit offsets do not reach."""
    needed = sum(map(sum, counts)) + 4096 * len(group) + sum(16 * len(c) for c in counts) >= 1 << 32
    big = needed if big is None else big
    for image in group:
        image.big = big
    zeros = [_entries(image, [0] * len(c), c, namespace) for image, c in zip(group, counts, strict=True)]
    starts, at = [], 16 if big else 8
    for e in zeros:
        starts.append(at)
        at += _directory_size(e, big)
    data = at
    out = [struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)]
    for i, (image, c) in enumerate(zip(group, counts, strict=True)):
        offsets = []
        for size in c:
            offsets.append(data)
            data += size
        out.append(_directory_bytes(_entries(image, offsets, c, namespace), starts[i], starts[i + 1] if i + 1 < len(group) else 0, big))
    return b"".join(out), big


def write(group: list[Image], tiles: list[Iterable[bytes]], namespace: str = "image", big: bool | None = None) -> bytes:
    """A file of these images; tiles are decoded samples in row-major order. Without tiles only metadata is written."""
    encoded = []
    for image, raw in zip(group, tiles, strict=True):
        own = []
        for i, data in enumerate(raw):
            w, _ = image.tile_size(i // image.cols)
            if len(data) != image.tile_bytes(i // image.cols):
                raise InvalidArgument("tile size")
            own.append(codecs.encode_tile(data, image.compression, image.predictor, w, image.channels, image.pixel_type))
        if own and len(own) != image.cols * image.rows:
            raise InvalidArgument("number of tiles")
        encoded.append(own)
    head, _ = plan(group, [[len(d) for d in own] or [0] * (i.cols * i.rows) for i, own in zip(group, encoded, strict=True)], namespace, big)
    return b"".join([head, *(d for own in encoded for d in own)])


class Canvas:
    """An image in memory whose tiles come in any order; those that never come are zero."""

    def __init__(self, image: Image):
        self.image, self.cols, self.rows = image, image.cols, image.rows
        self.size = image.tile_bytes(0)
        blank = bytes(self.size)
        self.tiles = [blank] * (self.cols * self.rows)
        self.written: set[int] = set()

    def write_tile(self, col: int, row: int, data: bytes) -> None:
        if not (0 <= col < self.cols and 0 <= row < self.rows):
            raise OutOfRange(f"tile {col}, {row}")
        if len(data) != self.size:
            raise InvalidArgument(f"a tile has {self.size} bytes")
        number = row * self.cols + col
        self.tiles[number] = bytes(data)
        self.written.add(number)

    def file(self, namespace: str = "image") -> bytes:
        return write([self.image], [self.tiles], namespace)

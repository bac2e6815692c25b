"""Tile codecs and predictors on bytes, for use in Arrow batches: LZW, PackBits, Deflate, Zstandard, JPEG, horizontal differences."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql.functions import pandas_udf

from tesserae.errors import InvalidArgument
from tesserae.functions import jpeg
from tesserae.functions.samples import dtype

_CLEAR, _END, _FIRST, _FULL = 256, 257, 258, 4094  # fixed values of the TIFF variant


def _pack(codes: list[tuple[int, int]]) -> bytes:
    """Codes and their widths, most significant bit first, zeros at the end."""
    widths = np.array([w for _, w in codes], np.int64)
    values = np.array([c for c, _ in codes], np.int64)
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for b in range(12):
        wide = widths > b
        bits[ends[wide] - 1 - b] = values[wide] >> b & 1
    return np.packbits(bits).tobytes()


def lzw_encode(data: bytes) -> bytes:
    table: dict[bytes, int] = {}
    out, held, free, width = [(_CLEAR, 9)], b"", _FIRST, 9
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            held = longer
            continue
        out.append((table[held] if len(held) > 1 else held[0], width))
        table[longer] = free
        free += 1
        width = free.bit_length() if free > 511 else 9
        if free == _FULL:
            out.append((_CLEAR, 12))
            table.clear()
            free, width = _FIRST, 9
        held = data[i : i + 1]
    if held:
        out.append((table[held] if len(held) > 1 else held[0], width))
        free += 1
        width = min(12, free.bit_length()) if free > 511 else 9
    out.append((_END, width))
    return _pack(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Exactly size bytes, or InvalidArgument."""
    out: list[bytes] = []
    single = [bytes([i]) for i in range(256)]
    table: list[bytes] = []
    last = b""
    width, buffer, held, made = 9, 0, 0, 0
    for byte in data:
        buffer = buffer << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = buffer >> held
        buffer &= (1 << held) - 1
        if code == _CLEAR:
            table, last, width = [], b"", 9
            continue
        if code == _END:
            break
        if code < 256:
            entry = single[code]
        elif code - _FIRST < len(table):
            entry = table[code - _FIRST]
        elif code - _FIRST == len(table) and last:
            entry = last + last[:1]
        else:
            raise InvalidArgument("LZW: code beyond the dictionary")
        if last:
            table.append(last + entry[:1])
        out.append(entry)
        made += len(entry)
        last = entry
        free = _FIRST + len(table) + 1
        width = 9 if free < 512 else min(12, free.bit_length())
        if made > size:
            raise InvalidArgument("LZW: more data than the tile holds")
    else:
        raise InvalidArgument("LZW: no end code")
    if made != size:
        raise InvalidArgument("LZW: less data than the tile holds")
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of two or more become repeats; all else is copied, 128 bytes at most each."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]])
    out = bytearray()
    literal = bytearray()

    def flush() -> None:
        for at in range(0, len(literal), 128):
            part = literal[at : at + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a == 1:
            literal.append(data[a])
            continue
        flush()
        left = b - a
        while left:
            n = min(left, 128)
            out.extend((257 - n, data[a]) if n > 1 else (0, data[a]))
            left -= n
    flush()
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            if at + n + 1 > len(data):
                raise InvalidArgument("PackBits: cut off")
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            if at >= len(data):
                raise InvalidArgument("PackBits: cut off")
            out += data[at : at + 1] * (257 - n)
            at += 1
    if len(out) != size:
        raise InvalidArgument("PackBits: another size than the tile's")
    return bytes(out)


def _inflate(data: bytes, size: int) -> bytes:
    try:
        out = zlib.decompress(data)
    except zlib.error as e:
        raise InvalidArgument(f"Deflate: {e}") from None
    if len(out) != size:
        raise InvalidArgument("Deflate: another size than the tile's")
    return out


def _unzstd(data: bytes, size: int) -> bytes:
    try:
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    except zstandard.ZstdError as e:
        raise InvalidArgument(f"Zstandard: {e}") from None
    if len(out) != size:
        raise InvalidArgument("Zstandard: another size than the tile's")
    return out


def _as_is(data: bytes, size: int) -> bytes:
    if len(data) != size:
        raise InvalidArgument("another size than the tile's")
    return data


ENCODERS = {"None": bytes, "LZW": lzw_encode, "PackBits": packbits_encode, "Deflate": zlib.compress, "Zlib": lambda d: zlib.compress(d, 6), "Zstd": lambda d: zstandard.ZstdCompressor(level=3).compress(d)}
DECODERS = {"None": _as_is, "LZW": lzw_decode, "PackBits": packbits_decode, "Deflate": _inflate, "Zlib": _inflate, "Zstd": _unzstd}


def payload_bound(compression: str, size: int) -> int:
    """The most bytes that a chunk can take when compressed."""
    return {"None": size, "Zlib": size + size // 1000 + 64, "Zstd": size + size // 256 + 64}[compression]


def predict(data: bytes, width: int, channels: int, pixel_type: str, little: bool = True) -> bytes:
    """Differences to the pixel before in each row and channel, wrapping."""
    if pixel_type in ("Float32", "Float64"):
        raise InvalidArgument("predictor 2 needs integer samples")
    x = np.frombuffer(data, dtype(pixel_type, little)).reshape(-1, width, channels)
    out = x.copy()
    out[:, 1:] -= x[:, :-1]
    return out.tobytes()


def unpredict(data: bytes, width: int, channels: int, pixel_type: str, little: bool = True) -> bytes:
    if pixel_type in ("Float32", "Float64"):
        raise InvalidArgument("predictor 2 needs integer samples")
    kind = dtype(pixel_type, little)
    x = np.frombuffer(data, kind).reshape(-1, width, channels)
    return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()


def _jpeg_rows(predictor: int, pixel_type: str, size: int, width: int, channels: int) -> int:
    if predictor == 2 or pixel_type != "UInt8":
        raise InvalidArgument("JPEG tiles hold 8-bit samples without a predictor")
    return size // (width * channels)


def encode_tile(data: bytes, compression: str, predictor: int, width: int, channels: int, pixel_type: str, little: bool = True) -> bytes:
    if compression == "Jpeg":
        return jpeg.encode(data, width, _jpeg_rows(predictor, pixel_type, len(data), width, channels), channels)
    if compression not in ENCODERS:
        raise InvalidArgument(f"compression {compression}")
    return ENCODERS[compression](predict(data, width, channels, pixel_type, little) if predictor == 2 else data)


def decode_tile(data: bytes, size: int, compression: str, predictor: int, width: int, channels: int, pixel_type: str, little: bool = True) -> bytes:
    if compression == "Jpeg":
        return jpeg.decode(data, width, _jpeg_rows(predictor, pixel_type, size, width, channels), channels)
    if compression not in DECODERS:
        raise InvalidArgument(f"compression {compression}")
    out = DECODERS[compression](data, size)
    return unpredict(out, width, channels, pixel_type, little) if predictor == 2 else out


def to_array(data: bytes, height: int, width: int, channels: int, pixel_type: str, little: bool = True) -> np.ndarray:
    return np.frombuffer(data, dtype(pixel_type, little)).reshape(height, width, channels)


def constant(value: float, samples: int, pixel_type: str) -> bytes:
    """value is cut to a whole number for integer samples."""
    return np.full(samples, value if pixel_type.startswith("Float") else int(value)).astype(dtype(pixel_type)).tobytes()


def packed(values: str, pixel_type: str):
    """A column of samples (array) as bytes of the type that another column names. Values are cut to whole numbers for integer samples."""

    @pandas_udf("binary")
    def pack(samples: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else np.asarray(s, np.float64).astype(dtype(k)).tobytes() for s, k in zip(samples, kinds, strict=True)])

    return pack(values, pixel_type)


def read_unsigned(data: bytes, at: int, size: int, little: bool) -> int:
    return int.from_bytes(data[at : at + size], "little" if little else "big")


def write_unsigned(value: int, size: int, little: bool = True) -> bytes:
    return struct.pack(("<" if little else ">") + {1: "B", 2: "H", 4: "I", 8: "Q"}[size], value)


def encode_column(compression: str):
    """A column function: binary to compressed binary, in Arrow batches."""

    @pandas_udf("binary")
    def encode(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else ENCODERS[compression](bytes(d)))

    return encode


def decode_column(compression: str):
    """A column function: compressed binary and its decoded size to binary."""

    @pandas_udf("binary")
    def decode(data: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else DECODERS[compression](bytes(d), int(n)) for d, n in zip(data, size, strict=True)])

    return decode

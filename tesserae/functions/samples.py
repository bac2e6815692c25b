"""Sample types of pixels: sizes, predicates and the names other formats use for them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# For each type its bytes, TIFF sample format and bits, and numpy kind.
TYPES = {
    "UInt8": (1, 1, 8, "u1"),
    "UInt16": (2, 1, 16, "u2"),
    "Int16": (2, 2, 16, "i2"),
    "UInt32": (4, 1, 32, "u4"),
    "Int32": (4, 2, 32, "i4"),
    "Float32": (4, 3, 32, "f4"),
    "Float64": (8, 3, 64, "f8"),
}
ALIASES = {
    "uint8": "UInt8", "u8": "UInt8", "byte": "UInt8", "uint16": "UInt16", "u16": "UInt16", "int16": "Int16", "i16": "Int16", "uint32": "UInt32", "u32": "UInt32",
    "int32": "Int32", "i32": "Int32", "float32": "Float32", "f32": "Float32", "float": "Float32", "float64": "Float64", "f64": "Float64", "double": "Float64",
}
COMPRESSIONS = {"none": "None", "uncompressed": "None", "lzw": "LZW", "packbits": "PackBits", "deflate": "Deflate", "zip": "Deflate", "zlib": "Deflate", "jpeg": "Jpeg", "jpg": "Jpeg"}
TIFF_COMPRESSIONS = {1: "None", 5: "LZW", 7: "Jpeg", 8: "Deflate", 32946: "Deflate", 32773: "PackBits"}


# The codes of sample types in other programs' headers, and what unknown ones count as.
CODES = {0: "UInt8", 1: "UInt16", 2: "UInt32", 3: "Float32", 4: "Float64", 5: "Int16", 6: "Int32"}


def from_code(code: Column) -> Column:
    return _choose(code, CODES, F.lit("UInt8"))


def to_code(pixel_type: Column) -> Column:
    return _choose(pixel_type, {v: k for k, v in CODES.items()}, F.lit(4))


def _choose(value: Column, table: dict, otherwise: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(table.values()))))
    for key, result in table.items():
        out = out.when(value == key, F.lit(result))
    return out if otherwise is None else out.otherwise(otherwise)


def _fail(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"INVALID_ARGUMENT: {message} "), F.coalesce(value.cast("string"), F.lit("null"))))


def sample_bytes(pixel_type: Column) -> Column:
    return _choose(pixel_type, {k: v[0] for k, v in TYPES.items()})


def sample_bits(pixel_type: Column) -> Column:
    return sample_bytes(pixel_type) * 8


def sample_format(pixel_type: Column) -> Column:
    """TIFF's: 1 unsigned, 2 signed, 3 floating."""
    return _choose(pixel_type, {k: v[1] for k, v in TYPES.items()})


def is_integer(pixel_type: Column) -> Column:
    return pixel_type.isin("UInt8", "UInt16", "Int16", "UInt32", "Int32")


def is_signed(pixel_type: Column) -> Column:
    return pixel_type.isin("Int16", "Int32", "Float32", "Float64")


def is_float(pixel_type: Column) -> Column:
    return pixel_type.isin("Float32", "Float64")


def from_tiff(form: Column, bits: Column, strict: bool = True) -> Column:
    """Sample type of a TIFF sample format and its bits; others raise, or are null if not strict."""
    out = F.when(F.lit(False), F.lit(""))
    for name, (_, f, b, _) in TYPES.items():
        out = out.when((form == f) & (bits == b), name)
    return out.otherwise(_fail("unsupported sample format", F.concat_ws("/", form, bits))) if strict else out


def uniform_bits(bits: Column) -> Column:
    return F.size(F.array_distinct(bits)) == 1


def parse_pixel_type(text: Column, strict: bool = True) -> Column:
    return _choose(F.lower(text), ALIASES, _fail("pixel type", text) if strict else None)


def parse_compression(text: Column, strict: bool = True) -> Column:
    return _choose(F.lower(text), COMPRESSIONS, _fail("compression", text) if strict else None)


def display_name(pixel_type: Column) -> Column:
    return F.lower(pixel_type)


def dtype(pixel_type: str, little: bool = True) -> np.dtype:
    return np.dtype(("<" if little else ">") + TYPES[pixel_type][3])


def name_of(form: int, bits: int) -> str | None:
    return next((k for k, v in TYPES.items() if v[1:3] == (form, bits)), None)

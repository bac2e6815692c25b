"""Payloads of metadata tags: a magic of five letters, a version, a count, then sorted keys and values.

The magic is the namespace in capitals, so a reader learns the namespace from the payload.
"""

from __future__ import annotations

import struct

from tesserae.errors import InvalidArgument

VERSION = 1
MAGIC_SIZE = 5


def encode(records: dict[str, str], namespace: str) -> bytes:
    """All integers are little-endian: u16 version, u32 count; for each record u16 and the key, u32 and the value."""
    magic = namespace.upper().encode("ascii")
    if len(magic) != MAGIC_SIZE:
        raise InvalidArgument("a namespace of five letters")
    out = [magic, struct.pack("<HI", VERSION, len(records))]
    for key, value in sorted((k.encode(), v.encode()) for k, v in records.items()):
        if len(key) > 0xFFFF:
            raise InvalidArgument("metadata key over 65535 bytes")
        out += [struct.pack("<H", len(key)), key, struct.pack("<I", len(value)), value]
    return b"".join(out)


def decode(data: bytes) -> tuple[str, dict[str, str]]:
    """Namespace and records."""
    at = MAGIC_SIZE + 6
    if len(data) < at or not data[:MAGIC_SIZE].isalpha():
        raise InvalidArgument("no metadata payload")
    version, count = struct.unpack_from("<HI", data, MAGIC_SIZE)
    if version > VERSION:
        raise InvalidArgument("metadata payload of a later version")
    out = {}
    for _ in range(count):
        parts = []
        for form in ("<H", "<I"):
            width = struct.calcsize(form)
            if at + width > len(data):
                raise InvalidArgument("metadata payload is cut off")
            (size,) = struct.unpack_from(form, data, at)
            at += width
            if at + size > len(data):
                raise InvalidArgument("metadata payload is cut off")
            parts.append(data[at : at + size].decode("utf-8", "replace"))
            at += size
        out[parts[0]] = parts[1]
    return data[:MAGIC_SIZE].decode("ascii").lower(), out

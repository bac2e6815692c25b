"""Baseline JPEG of 8-bit gray or RGB tiles: sequential Huffman streams, written without chroma subsampling.

Blocks are transformed, quantised and coded as whole arrays; only the reader's walk over the bits is a loop. Huffman
tables are made for each image from its own symbols, so none is written down here.
"""

from __future__ import annotations

import heapq
import math
import struct

import numpy as np

from tesserae.errors import InvalidArgument

QUALITY = 90
# Fixed values of the standard: quantisation of luminance and chrominance at quality 50, by rows.
LUMINANCE = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)
CHROMINANCE = np.full((8, 8), 99)
CHROMINANCE[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]

# Places by anti-diagonals, up and down in turn.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
DCT = np.array([[math.sqrt((1 if k == 0 else 2) / 8) * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)])
END_OF_BLOCK, SIXTEEN_ZEROS = 0x00, 0xF0


def quantiser(base: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def _to_ycc(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.float64) for i in range(3))
    return np.stack([0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128], -1)


def _to_rgb(ycc: np.ndarray) -> np.ndarray:
    y, cb, cr = ycc[..., 0], ycc[..., 1] - 128, ycc[..., 2] - 128
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of a value's size."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman lengths of used symbols, at most 16 bits and none all ones: one more symbol takes that code."""
    n = counts.astype(np.int64)
    while True:
        heap = [(1, -1, (-1,))] + [(int(n[s]), s, (s,)) for s in np.flatnonzero(n)]
        lengths = dict.fromkeys((s for _, s, _ in heap), 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, _, left), (b, s, right) = heapq.heappop(heap), heapq.heappop(heap)
            for x in (*left, *right):
                lengths[x] += 1
            heapq.heappush(heap, (a + b, s, left + right))
        if max(lengths.values()) <= 16:
            longest = max(lengths, key=lambda s: (lengths[s], s == -1))
            lengths[longest], lengths[-1] = lengths[-1], lengths[longest]
            return {s: x for s, x in lengths.items() if s >= 0}
        n = np.where(n > 0, n // 2 + 1, 0)


def _codes(lengths: dict[int, int]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Counts by length and symbols in order, as in a file; and each symbol's code and length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last = 0, 0
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    return bytes(sum(x == n for x in lengths.values()) for n in range(1, 17)), bytes(order), codes, sizes


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of blocks of quantised values in zigzag order: owner, place, symbol and extra value of each code; place 0 is the DC difference."""
    dc = np.diff(blocks[:, 0], prepend=0)
    owner, place = np.nonzero(blocks[:, 1:])
    place = place + 1
    value = blocks[owner, place]
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    before = np.where(first, 0, np.r_[0, place[:-1]]) if len(owner) else place
    run = place - before - 1
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, owner, place)
    n = len(blocks)
    long = run // 16  # stretches of sixteen zeros before a value
    zeros = np.repeat(np.arange(len(owner)), long)
    ends = np.flatnonzero(last < 63)
    parts = [
        (np.arange(n), np.zeros(n, np.int64), _sizes(dc), dc),
        (owner[zeros], place[zeros] * 2 - 1, np.full(len(zeros), SIXTEEN_ZEROS), np.zeros(len(zeros), np.int64)),
        (owner, place * 2, (run % 16) << 4 | _sizes(value), value),
        (ends, np.full(len(ends), 200), np.full(len(ends), END_OF_BLOCK), np.zeros(len(ends), np.int64)),
    ]
    out = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def _bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    bits = np.ones(int(ends[-1] + (-ends[-1]) % 8), np.uint8)
    for b in range(int(widths.max())):
        wide = widths > b
        bits[ends[wide] - 1 - b] = values[wide] >> b & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(data: bytes, width: int, height: int, channels: int, quality: int = QUALITY) -> bytes:
    """A baseline stream; quality from 1 to 100 (0 counts as 1)."""
    if not 0 <= quality <= 100 or channels not in (1, 3) or not 0 < width < 1 << 16 or not 0 < height < 1 << 16 or len(data) != width * height * channels:
        raise InvalidArgument("JPEG: quality, size or channels")
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    planes = _to_ycc(pixels) if channels == 3 else pixels.astype(np.float64)
    planes = np.pad(planes, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge") - 128
    tables = [quantiser(t, max(quality, 1)) for t in ((LUMINANCE, CHROMINANCE) if channels == 3 else (LUMINANCE,))]
    coded = []
    for c in range(channels):
        p = planes[:, :, c]
        blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        quantised = np.rint(DCT @ blocks @ DCT.T / tables[min(c, 1)]).astype(np.int64)
        coded.append(_symbols(quantised.reshape(-1, 64)[:, ZIGZAG]))
    out = [b"\xff\xd8"]
    out += [_segment(0xDB, bytes([i]) + t.reshape(64)[ZIGZAG].astype(np.uint8).tobytes()) for i, t in enumerate(tables)]
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, height, width, channels) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(channels))))
    owner, order, value, width_of = [], [], [], []
    for group in range(len(tables)):
        own = [coded[c] for c in ((0,) if group == 0 else (1, 2))]
        made = []
        for kind in (0, 1):
            used = np.concatenate([s[(place > 0) == kind] for _, place, s, _ in own])
            made.append(_codes(_code_lengths(np.bincount(used, minlength=256))))
            out.append(_segment(0xC4, bytes([kind << 4 | group]) + made[kind][0] + made[kind][1]))
        for c, (block, place, symbol, extra) in zip((0,) if group == 0 else (1, 2), own, strict=True):
            ac = place > 0
            code, size = (np.where(ac, made[1][i][symbol], made[0][i][symbol]) for i in (2, 3))
            more = np.where(ac, symbol & 15, symbol)
            low = np.where(extra < 0, extra + (1 << more) - 1, extra)
            owner.append(block * channels + c)
            order.append(place)
            value.append(code << more | low)
            width_of.append(size + more)
    out.append(_segment(0xDA, bytes([channels]) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(channels)) + bytes([0, 63, 0])))
    owner, order, value, width_of = (np.concatenate(x) for x in (owner, order, value, width_of))
    at = np.lexsort((order, owner))
    return b"".join([*out, _bits(value[at], width_of[at]), b"\xff\xd9"])


class _Table:
    """Sixteen bits to a code's length and symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.sizes, self.symbols = [0] * 65_536, [0] * 65_536
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                low = code << 16 - length
                high = low + (1 << 16 - length)
                if high > 65_536 or at >= len(symbols):
                    raise InvalidArgument("JPEG: Huffman table")
                self.sizes[low:high] = [length] * (high - low)
                self.symbols[low:high] = [symbols[at]] * (high - low)
                code += 1
                at += 1
            code <<= 1


def _scan(data: bytes, parts: list, blocks: dict[int, np.ndarray], order: list[tuple[int, int]], units: int, restart: int) -> None:
    """Fills blocks of quantised values; order: of each unit, (component, places a unit)."""
    segments = []
    at = 0
    while True:  # restart markers part the stream
        end = data.find(b"\xff", at)
        while 0 <= end < len(data) - 1 and data[end + 1] == 0:
            end = data.find(b"\xff", end + 2)
        segments.append(data[at : end if end >= 0 else len(data)].replace(b"\xff\x00", b"\xff"))
        if end < 0 or end + 1 >= len(data) or not 0xD0 <= data[end + 1] <= 0xD7:
            break
        at = end + 2
    filled = dict.fromkeys(blocks, 0)
    for i, segment in enumerate(segments):
        first = i * restart if restart else 0
        if first >= units:
            break
        n = min(restart or units, units - first)
        place, limit = 0, 8 * len(segment)
        before = dict.fromkeys(blocks, 0)
        words = np.frombuffer(segment + b"\xff" * 8, np.uint8).astype(np.int64)
        window = (words[:-3] << 24 | words[1:-2] << 16 | words[2:-1] << 8 | words[3:]).tolist()
        for _ in range(n):
            for component, count in order:
                dc, ac = parts[component]
                for _ in range(count):
                    out = blocks[component][filled[component]]
                    filled[component] += 1
                    k = 0
                    while k < 64:
                        if place > limit:
                            raise InvalidArgument("JPEG: stream is cut off")
                        table = ac if k else dc
                        peek = (window[place >> 3] >> 16 - (place & 7)) & 0xFFFF
                        size = table.sizes[peek]
                        if not size:
                            raise InvalidArgument("JPEG: no such code")
                        symbol = table.symbols[peek]
                        place += size
                        if k:
                            if symbol == END_OF_BLOCK:
                                break
                            k += symbol >> 4
                            more = symbol & 15
                            if not more:
                                k += 1
                                continue
                        else:
                            more = symbol
                        value = 0
                        if more:
                            value = (window[place >> 3] >> 32 - (place & 7) - more) & (1 << more) - 1
                            place += more
                            if not value >> more - 1:
                                value -= (1 << more) - 1
                        if k > 63:
                            raise InvalidArgument("JPEG: block overflows")
                        if not k:
                            before[component] += value
                            value = before[component]
                        out[k] = value
                        k += 1


def decode(data: bytes, width: int, height: int, channels: int) -> bytes:
    """Samples of a baseline stream whose size and channels are these."""
    if channels not in (1, 3):
        raise InvalidArgument("JPEG: channels")
    try:
        return _decode(data, width, height, channels)
    except (struct.error, IndexError, KeyError, ValueError) as e:
        raise InvalidArgument(f"JPEG: {e}") from None


def _decode(data: bytes, width: int, height: int, channels: int) -> bytes:
    if data[:2] != b"\xff\xd8":
        raise InvalidArgument("JPEG: no start")
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[int, _Table] = {}
    frame, restart, transform, at = [], 0, 1, 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        mark, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, 1)
                table = np.zeros(64, np.int64)
                table[ZIGZAG] = values
                quantisers[body[0] & 15], body = table.reshape(8, 8), body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = _Table(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif mark == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif mark == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif mark in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if (depth, h, w, n) != (8, height, width, channels):
                raise InvalidArgument("JPEG: another size or other channels than the tile's")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= mark <= 0xCF:
            raise InvalidArgument("JPEG: not baseline")
        elif mark == 0xDA:
            break
    if body[0] != channels or not frame:
        raise InvalidArgument("JPEG: scans of single components")
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(channels)}
    wide, tall = max(f[1] for f in frame), max(f[2] for f in frame)
    if channels == 1:
        frame, wide, tall = [(frame[0][0], 1, 1, frame[0][3])], 1, 1
    columns, rows = -(-width // (8 * wide)), -(-height // (8 * tall))
    blocks = {i: np.zeros((columns * rows * h * v, 64), np.int64) for i, (_, h, v, _) in enumerate(frame)}
    parts = [(tables[chosen[f[0]] >> 4], tables[0x10 | chosen[f[0]] & 15]) for f in frame]
    _scan(data[at:], parts, blocks, [(i, h * v) for i, (_, h, v, _) in enumerate(frame)], columns * rows, restart)
    planes = []
    for i, (_, h, v, q) in enumerate(frame):
        straight = np.zeros_like(blocks[i])
        straight[:, ZIGZAG] = blocks[i]
        pixels = DCT.T @ (straight.reshape(-1, 8, 8) * quantisers[q]) @ DCT
        plane = pixels.reshape(rows, columns, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * v * 8, columns * h * 8)
        planes.append(np.repeat(np.repeat(plane, tall // v, 0), wide // h, 1)[:height, :width] + 128)
    whole = np.stack(planes, -1)
    return np.clip(np.rint(_to_rgb(whole) if channels == 3 and transform else whole), 0, 255).astype(np.uint8).tobytes()

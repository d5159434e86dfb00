"""Lossless WebP (VP8L): a whole decoder, an encoder, and media columns of both.

The decoder reads prefix codes (simple, normal and in groups chosen by an entropy image),
back-references, the colour cache and the predictor, cross-colour, subtract-green and
palette transforms, and writes pixels as an array of 0xAARRGGBB.  Images of one literal
channel, such as grey ones, are decoded many at once: the code at every bit position is
looked up, and the positions where codes really begin are then found by following the
lengths eight codes at a time.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tollhouse.llm import words as W
from tollhouse.llm.shingles import flat_bytes

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
#: Longest code of the grey encoder; the tables of the joint decoder have 2**MOST_BITS entries.
MOST_BITS = 11
#: Order in which the lengths of the code-length code are stored (fixed values of the format).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (x, y) of the 120 short distance codes (fixed values of the format).
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Reads bits, the least significant of each byte first."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw + bytes(8), at
        self.end = len(raw) * 8

    def read(self, n: int) -> int:
        b = self.at >> 3
        value = int.from_bytes(self.raw[b : b + 8], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return value

    def peek(self) -> int:
        b = self.at >> 3
        return int.from_bytes(self.raw[b : b + 4], "little") >> (self.at & 7)


def _reversed_bits(value: int, n: int) -> int:
    return int(f"{value:0{n}b}"[::-1], 2) if n else 0


class Code:
    """A canonical prefix code: decoding table and, per symbol, its bits as they are stored."""

    def __init__(self, lengths: dict[int, int]):
        used = sorted((n, s) for s, n in lengths.items() if n)
        self.lengths = lengths
        self.single = used[0][1] if len(used) == 1 else 0 if not used else None
        self.codes: dict[int, tuple[int, int]] = {}
        if self.single is not None:
            self.most, self.table = 0, [(self.single, 0)]
            self.codes[self.single] = (0, 0)
            return
        self.most = used[-1][0]
        self.table = [None] * (1 << self.most)
        code = last = 0
        for n, s in used:
            code <<= n - last
            last = n
            if code >> n:
                raise ValueError("a prefix code is over-full")
            stored = _reversed_bits(code, n)
            self.codes[s] = (stored, n)
            for i in range(stored, 1 << self.most, 1 << n):
                self.table[i] = (s, n)
            code += 1
        if code != 1 << last:
            raise ValueError("a prefix code is not complete")

    def read(self, bits: Bits) -> int:
        symbol, n = self.table[bits.peek() & (1 << self.most) - 1]
        bits.at += n
        return symbol


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return Code({first: 1, bits.read(8): 1} if two else {first: 1})
    lengths = {CODE_LENGTH_ORDER[i]: bits.read(3) for i in range(4 + bits.read(4))}
    code = Code(lengths)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    out: dict[int, int] = {}
    at, before = 0, 8
    while at < size and most:
        most -= 1
        n = code.read(bits)
        if n < 16:
            if n:
                out[at] = before = n
            at += 1
            continue
        again, value = (3 + bits.read(2), before) if n == 16 else (3 + bits.read(3), 0) if n == 17 else (11 + bits.read(7), 0)
        if at + again > size:
            raise ValueError("code lengths run over")
        if value:
            out.update((i, value) for i in range(at, at + again))
        at += again
    return Code(out)


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


class Head:
    """What stands before the pixels of an entropy-coded image."""

    def __init__(self, bits: Bits, width: int, height: int, top: bool):
        self.cache = bits.read(4) if bits.read(1) else 0
        self.tile, self.groups = 0, None
        count = 1
        if top and bits.read(1):
            self.tile = bits.read(3) + 2
            self.across = -(-width >> self.tile)
            self.groups = (_image(bits, self.across, -(-height >> self.tile)) >> 8 & 0xFFFF).tolist()
            count = max(self.groups) + 1
        sizes = (280 + (1 << self.cache if self.cache else 0), 256, 256, 256, 40)
        self.codes = [[_read_code(bits, n) for n in sizes] for _ in range(count)]


def _image(bits: Bits, width: int, height: int, head: Head | None = None) -> np.ndarray:
    """Pixels of an entropy-coded image, as stored before transforms are inverted."""
    head = head or Head(bits, width, height, False)
    n = width * height
    out = [0] * n
    cache, shift, marked = [0] * (1 << head.cache), 32 - head.cache, 0
    codes = head.codes[0]
    at = 0
    while at < n:
        if head.groups is not None:
            codes = head.codes[head.groups[(at // width >> head.tile) * head.across + (at % width >> head.tile)]]
        s = codes[GREEN].read(bits)
        if s < 256:
            red = codes[RED].read(bits)
            blue = codes[BLUE].read(bits)
            out[at] = codes[ALPHA].read(bits) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            code = _extra(bits, codes[DISTANCE].read(bits))
            if code > 120:
                back = code - 120
            else:
                x, y = NEIGHBOURS[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            if back >= length:
                out[at : at + length] = out[at - back : at - back + length]
            else:
                unit = out[at - back : at]
                out[at : at + length] = (unit * (length // back + 1))[:length]
            at += length
        else:
            # Pixels enter the cache as late as it is asked.
            for v in out[marked:at]:
                cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = v
            marked = at
            out[at] = cache[s - 280]
            at += 1
        if bits.at > bits.end:
            raise ValueError("the image ends early")
    return np.array(out, dtype=np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) of alpha, red, green, blue."""
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _select(left, top, corner):
    toward_left = np.abs(top - corner).sum(axis=-1)
    toward_top = np.abs(left - corner).sum(axis=-1)
    return left if toward_left < toward_top else top


def _predict(mode: int, left, top, corner, right):
    """Prediction from the left, upper, upper left and upper right pixels."""
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode in (6, 7, 8, 9):
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return a + b >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        # The halved difference is rounded toward zero.
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)
    raise ValueError(f"predictor {mode}")


_ROW_MODES = (0, 2, 3, 4, 8, 9)


def _predictions(image: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or takes away the predictions; image is (h, w, 4)."""
    height, width, _ = image.shape
    source = image.copy()
    out = source if inverse else image.copy()
    sign = 1 if inverse else -1
    known = out if inverse else source
    for y in range(height):
        row = modes[y >> bits]
        x = 0
        while x < width:
            mode = 0 if x == 0 and y == 0 else 1 if y == 0 else 2 if x == 0 else int(row[x >> bits])
            to = 1 if x == 0 else width if y == 0 else min(width, (x >> bits) + 1 << bits)
            if mode in _ROW_MODES and y:
                above = np.concatenate([known[y - 1], known[y, :1]])
                span = slice(x, to)
                corner = above[x - 1 : to - 1] if x else above[:1]
                out[y, span] = source[y, span] + sign * _predict(mode, None, above[span], corner, above[x + 1 : to + 1]) & 255
            elif mode == 1 and inverse:
                out[y, x:to] = np.cumsum(np.concatenate([out[y, x - 1 : x], source[y, x:to]]), axis=0)[1:] & 255
            else:
                for i in range(x, to):
                    left = known[y, i - 1] if i else None
                    top = known[y - 1, i] if y else None
                    corner = known[y - 1, i - 1] if y and i else None
                    right = (known[y - 1, i + 1] if i + 1 < width else known[y, 0]) if y else None
                    out[y, i] = source[y, i] + sign * _predict(mode, left, top, corner, right) & 255
            x = to
    return out


def _crossed(image: np.ndarray, elements: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    height, width, _ = image.shape
    each = elements[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits].astype(np.int8).astype(np.int32)
    signed = image.astype(np.int8).astype(np.int32)
    green, red = signed[..., 2], signed[..., 1]
    out, sign = image.copy(), 1 if inverse else -1
    out[..., 1] = image[..., 1] + sign * (each[..., 3] * green >> 5) & 255
    if inverse:
        red = out[..., 1].astype(np.int8).astype(np.int32)
    out[..., 3] = image[..., 3] + sign * ((each[..., 2] * green >> 5) + (each[..., 1] * red >> 5)) & 255
    return out


def _chunk(raw: bytes) -> bytes:
    if raw[:4] != b"RIFF" or raw[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return raw[20 : 20 + struct.unpack_from("<I", raw, 16)[0]]


class Stream:
    """The transforms and the head of an image, read; the pixels begin at ``bits.at``."""

    def __init__(self, raw: bytes):
        bits = self.bits = Bits(_chunk(raw))
        if bits.read(8) != 0x2F:
            raise ValueError("not a lossless WebP stream")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("an unknown version")
        self.transforms: list[tuple] = []
        width = self.width
        while bits.read(1):
            kind = bits.read(2)
            if kind in (PREDICTOR, CROSS_COLOR):
                size = bits.read(3) + 2
                across, down = -(-width >> size), -(-self.height >> size)
                self.transforms.append((kind, width, size, _channels(_image(bits, across, down).reshape(down, across))))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, width))
            else:
                n = bits.read(8) + 1
                table = np.cumsum(_channels(_image(bits, n, 1)), axis=0) & 255
                packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, width, packing, _packed(table)))
                width = -(-width >> packing)
        self.coded_width = width
        self.head = Head(bits, width, self.height, True)

    def pixels(self) -> np.ndarray:
        """(height, width) of 0xAARRGGBB."""
        image = _image(self.bits, self.coded_width, self.height, self.head).reshape(self.height, -1)
        for kind, width, *rest in reversed(self.transforms):
            if kind == PALETTE:
                packing, table = rest
                index = image >> np.uint32(8) & np.uint32(255)
                if packing:
                    each = 8 >> packing
                    parts = [index >> np.uint32(each * i) & np.uint32((1 << each) - 1) for i in range(1 << packing)]
                    index = np.stack(parts, axis=-1).reshape(self.height, -1)[:, :width]
                whole = np.zeros(256, dtype=np.uint32)
                whole[: len(table)] = table
                image = whole[index]
                continue
            channels = _channels(image)
            if kind == SUBTRACT_GREEN:
                channels[..., 1] += channels[..., 2]
                channels[..., 3] += channels[..., 2]
            elif kind == PREDICTOR:
                channels = _predictions(channels, rest[1][..., 2] & 15, rest[0], True)
            else:
                channels = _crossed(channels, rest[1], rest[0], True)
            image = _packed(channels)
        return image


def decode(raw: bytes) -> np.ndarray:
    """(height, width) of 0xAARRGGBB of a lossless WebP file."""
    return Stream(raw).pixels()


# Encoding


class _Writer:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def code(self, stored: tuple[int, int]) -> None:
        self.put(*stored)

    def bytes(self) -> bytes:
        values, sizes = np.array(self.values, dtype=np.uint64), np.array(self.sizes, dtype=np.int64)
        return pack_bits(values, sizes, np.array([0, len(sizes)]))[0]


def pack_bits(values: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Bytes of each stream; stream i has the fields ``bounds[i]`` to ``bounds[i+1]``, each below 25 bits."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bits = ends[bounds[1:]] - ends[bounds[:-1]]
    words = (bits + 31) // 32 + 1
    first = np.cumsum(words) - words
    at = ends[:-1] + np.repeat(first * 32 - ends[bounds[:-1]], np.diff(bounds))
    word = at >> 5
    moved = values << (at & 31).astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, dtype=np.uint64)
    if len(word):
        heads = np.flatnonzero(np.concatenate([[True], np.diff(word) > 0]))
        sums = np.add.reduceat(moved, heads)
        out[word[heads]] += sums & np.uint64(0xFFFFFFFF)
        out[word[heads] + 1] += sums >> np.uint64(32)
    raw = out.astype("<u4").tobytes()
    return [raw[4 * f : 4 * f + (b + 7) // 8] for f, b in zip(first.tolist(), bits.tolist(), strict=True)]


def _huffman(counts: Counter, most: int) -> dict[int, int]:
    """Code lengths of at most ``most`` bits."""
    if len(counts) <= 1:
        return {s: 1 for s in counts} or {0: 1}
    floor = 1
    while True:
        heap = [(max(n, floor), i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        lengths, serial = dict.fromkeys(counts, 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
            serial += 1
        if max(lengths.values()) <= most:
            return lengths
        floor = floor * 2 + sum(counts.values()) // (1 << most)


def _write_code(out: _Writer, lengths: dict[int, int], size: int) -> Code:
    code = Code(lengths)
    used = sorted(s for s, n in lengths.items() if n)
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(wide, 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return Code({s: 1 for s in used})
    items: list[tuple[int, int, int]] = []
    at, before = 0, 8
    while at < size:
        n = lengths.get(at, 0)
        run = 1
        while at + run < size and lengths.get(at + run, 0) == n:
            run += 1
        at += run
        if n == 0:
            while run >= 11:
                items.append((18, min(run, 138) - 11, 7))
                run -= min(run, 138)
            if run >= 3:
                items.append((17, run - 3, 3))
                run = 0
        else:
            if n != before:
                items.append((n, 0, 0))
                before, run = n, run - 1
            while run >= 3:
                items.append((16, min(run, 6) - 3, 2))
                run -= min(run, 6)
        items += [(n, 0, 0)] * run
    inner = Code(_huffman(Counter(s for s, _, _ in items), 7))
    out.put(0, 1)
    out.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        out.put(inner.lengths.get(s, 0), 3)
    out.put(0, 1)
    for s, value, n in items:
        out.code(inner.codes[s])
        if n:
            out.put(value, n)
    return code


def _prefixed(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    return 2 * n + 2 + ((value - 1 >> n) & 1), (value - 1) & (1 << n) - 1, n


def _tokens(pixels: list[int], lz: bool, cache_bits: int) -> list[tuple[int, int]]:
    """(pixel, 0), (-cache index - 1, 0) or (length, distance)."""
    out: list[tuple[int, int]] = []
    last: dict[tuple, int] = {}
    cache: dict[int, int] = {}
    n, at = len(pixels), 0

    def enter(v: int) -> None:
        if cache_bits:
            cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits] = v

    while at < n:
        back = 0
        if lz and at + 4 <= n:
            key = tuple(pixels[at : at + 4])
            back = at - last[key] if key in last else 0
            last[key] = at
        if back:
            length = 4
            while length < 4096 and at + length < n and pixels[at + length] == pixels[at + length - back]:
                length += 1
            out.append((length, back))
            for v in pixels[at : at + length] if cache_bits else ():
                enter(v)
            at += length
            continue
        v = pixels[at]
        slot = (v * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits if cache_bits else -1
        out.append((-slot - 1, 0) if cache_bits and cache.get(slot) == v else (v, 0))
        enter(v)
        at += 1
    return out


def _write_image(out: _Writer, pixels: np.ndarray, top: bool, lz: bool = False, cache_bits: int = 0, tile: int = 0) -> None:
    """An entropy-coded image; with ``tile``, codes are chosen by square from two groups, by turns."""
    height, width = pixels.shape
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    across = -(-width >> tile)
    if top:
        out.put(tile > 0, 1)
        if tile:
            out.put(tile - 2, 3)
            down = -(-height >> tile)
            which = (np.arange(down)[:, None] + np.arange(across)[None, :]) % 2
            _write_image(out, (which << 8).astype(np.uint32), False)
    groups = 2 if tile and top and -(-height >> tile) * across > 1 else 1
    near = {x + y * width: i + 1 for i, (x, y) in reversed([*enumerate(NEIGHBOURS)]) if x + y * width > 0}
    fields: list[tuple[int, list[tuple[int, int, int, int]]]] = []
    counts = [[Counter() for _ in range(5)] for _ in range(groups)]
    at = 0
    for value, back in _tokens(pixels.ravel().tolist(), lz, cache_bits):
        g = ((at // width >> tile) + (at % width >> tile)) % 2 if groups == 2 else 0
        if back:
            (p, x, n), (q, y, m) = _prefixed(value), _prefixed(near.get(back, back + 120))
            part = [(GREEN, 256 + p, x, n), (DISTANCE, q, y, m)]
            at += value
        else:
            part = [(GREEN, 280 - value - 1, 0, 0)] if value < 0 else [(GREEN, value >> 8 & 255, 0, 0), (RED, value >> 16 & 255, 0, 0), (BLUE, value & 255, 0, 0), (ALPHA, value >> 24, 0, 0)]
            at += 1
        for kind, s, _, _ in part:
            counts[g][kind][s] += 1
        fields.append((g, part))
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_write_code(out, _huffman(c, 15), n) for c, n in zip(counts[g], sizes, strict=True)] for g in range(groups)]
    for g, part in fields:
        for kind, s, x, n in part:
            out.code(codes[g][kind].codes[s])
            if n:
                out.put(x, n)


def _file(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), lz: bool = True, cache_bits: int = 0, tile: int = 0, predictor: int | np.ndarray = 11, cross: tuple[int, int, int] = (3, 5, 7), bits: int = 3) -> bytes:
    """A lossless WebP file of (height, width) pixels 0xAARRGGBB, with the given transforms in order.

    ``predictor`` is one mode or one a square; ``cross`` are red to blue, green to blue and green to red.
    """
    height, width = pixels.shape
    out = _Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    image = pixels.astype(np.uint32)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        down, across = -(-image.shape[0] >> bits), -(-image.shape[1] >> bits)
        channels = _channels(image)
        if kind == PREDICTOR:
            modes = np.broadcast_to(np.asarray(predictor), (down, across))
            image = _packed(_predictions(channels, modes, bits, False))
            out.put(bits - 2, 3)
            _write_image(out, (modes << 8).astype(np.uint32) | np.uint32(0xFF000000), False)
        elif kind == CROSS_COLOR:
            element = np.broadcast_to(np.array([255, *cross]), (down, across, 4))
            image = _packed(_crossed(channels, element, bits, False))
            out.put(bits - 2, 3)
            _write_image(out, _packed(element), False)
        elif kind == SUBTRACT_GREEN:
            channels[..., 1] -= channels[..., 2]
            channels[..., 3] -= channels[..., 2]
            image = _packed(channels)
        else:
            table, index = np.unique(image, return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette has 256 colours at most")
            out.put(len(table) - 1, 8)
            _write_image(out, _packed(np.diff(_channels(table), axis=0, prepend=0))[None, :], False)
            packing = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index = index.reshape(image.shape).astype(np.uint32)
            if packing:
                wide = -(-image.shape[1] >> packing) << packing
                filled = np.zeros((height, wide), dtype=np.uint32)
                filled[:, : image.shape[1]] = index
                parts = filled.reshape(height, -1, 1 << packing)
                index = sum(parts[..., i] << np.uint32((8 >> packing) * i) for i in range(1 << packing))
            image = index << np.uint32(8) | np.uint32(0xFF000000)
    out.put(0, 1)
    _write_image(out, image, True, lz, cache_bits, tile)
    return _file(out.bytes())


# Many grey images at once

_REVERSED = np.array([_reversed_bits(i, MOST_BITS) for i in range(1 << MOST_BITS)])
#: Lengths of the code for code lengths: 3 bits for "unused" and 18, 4 for the rest; complete.
_INNER = Code({0: 3, 18: 3, 17: 4, **{n: 4 for n in range(1, 12)}})
_OPENING = ((0x2F, 8), None, None, (0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1), (0, 1), (15, 4), *((_INNER.lengths.get(s, 0), 3) for s in CODE_LENGTH_ORDER), (1, 1), (3, 3), None)
#: Red and blue are 0 and alpha is 255 throughout; no distances.
_CLOSING = (*((1, 1), (0, 1), (0, 1), (0, 1)) * 2, (1, 1), (0, 1), (1, 1), (255, 8), (1, 1), (0, 1), (0, 1), (0, 1))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete code lengths of up to ``MOST_BITS`` for each row of symbol counts (a single symbol gets 1)."""
    total = counts.sum(axis=1, keepdims=True)
    raised = np.where(counts > 0, np.maximum(counts, -(-total // 1024)), 0)
    share = raised.sum(axis=1, keepdims=True) / np.maximum(raised, 1)
    lengths = np.where(raised > 0, np.maximum(1, np.ceil(np.log2(share) - 1e-12)), 0).astype(np.int64)
    order = np.argsort(-raised, axis=1, kind="stable")
    ranked = np.take_along_axis(lengths, order, axis=1)
    spare = (1 << MOST_BITS) - np.where(ranked > 0, 1 << MOST_BITS - ranked, 0).sum(axis=1)
    spare[(ranked > 0).sum(axis=1) < 2] = 0
    while spare.any():
        for n in range(MOST_BITS, 1, -1):
            gain = 1 << MOST_BITS - n
            if not (spare >= gain).any():
                continue
            there = ranked == n
            taken = there & (np.cumsum(there, axis=1) <= (spare // gain)[:, None])
            ranked[taken] -= 1
            spare = spare - taken.sum(axis=1) * gain
    np.put_along_axis(lengths, order, ranked, axis=1)
    return lengths


def encode_grey(samples: np.ndarray, bounds: np.ndarray, width: int, heights: np.ndarray) -> list[bytes]:
    """Files of many grey images of one width; image i has the samples ``bounds[i]`` to ``bounds[i+1]``."""
    n = len(heights)
    of = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(of * 256 + samples, minlength=n * 256).reshape(n, 256)
    lengths = code_lengths(counts)
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    ranked = np.take_along_axis(lengths, order, axis=1)
    room = np.where(ranked > 0, 1 << MOST_BITS - ranked, 0)
    starts = np.minimum(np.cumsum(room, axis=1) - room, (1 << MOST_BITS) - 1)
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, _REVERSED[starts], axis=1)
    single = (lengths > 0).sum(axis=1) == 1
    bits = np.where(single[:, None], 0, lengths)
    codes[single] = 0
    used = 256 - np.argmax(lengths[:, ::-1] > 0, axis=1)
    most = np.maximum(used, 2)
    inner = np.zeros((16, 2), dtype=np.int64)
    for s, x in _INNER.codes.items():
        if s < 16:
            inner[s] = x
    opening = np.array([x or (0, 14) for x in _OPENING])
    opening[-1, 1] = 8
    heads = np.broadcast_to(opening, (n, *opening.shape)).copy()
    heads[:, 1, 0], heads[:, 2, 0], heads[:, -1, 0] = width - 1, heights - 1, most - 2
    closing = np.array(_CLOSING)
    sizes = len(opening) + most + len(closing) + np.diff(bounds)
    ends = np.cumsum(sizes)
    fields = np.empty((int(ends[-1]), 2), dtype=np.int64)
    begin = ends - sizes
    fields[(begin[:, None] + np.arange(len(opening))).ravel()] = heads.reshape(-1, 2)
    row = np.repeat(np.arange(n), most)
    symbol = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
    fields[begin[row] + len(opening) + symbol] = inner[lengths[row, symbol]]
    fields[((begin + len(opening) + most)[:, None] + np.arange(len(closing))).ravel()] = np.broadcast_to(closing, (n, *closing.shape)).reshape(-1, 2)
    place = np.arange(len(samples)) + (ends - bounds[1:])[of]
    flat = of * 256 + samples
    fields[place, 0], fields[place, 1] = codes.ravel()[flat], bits.ravel()[flat]
    return [_file(x) for x in pack_bits(fields[:, 0].astype(np.uint64), fields[:, 1], np.concatenate([[0], ends]))]


def _is_grey(stream: Stream) -> bool:
    head = stream.head
    green, red, blue, alpha, _ = head.codes[0]
    plain = stream.transforms == [(SUBTRACT_GREEN, stream.width)] and not head.cache and head.groups is None
    return plain and red.single == 0 and blue.single == 0 and alpha.single == 255 and green.most <= MOST_BITS and max(green.lengths) < 256


def decode_grey(files: list[bytes]) -> list[bytes]:
    """The samples of each file: jointly where it is a plain grey image, one by one otherwise (green is taken)."""
    out: list[bytes] = [b""] * len(files)
    joint: list[tuple[int, Stream]] = []
    for i, raw in enumerate(files):
        stream = Stream(raw)
        if not _is_grey(stream):
            out[i] = (stream.pixels() >> np.uint32(8)).astype(np.uint8).tobytes()
        elif (s := stream.head.codes[0][GREEN].single) is not None:
            out[i] = bytes([s]) * (stream.width * stream.height)
        else:
            joint.append((i, stream))
    if not joint:
        return out
    n, size = len(joint), 1 << MOST_BITS
    lengths = np.zeros((n, 256), dtype=np.int64)
    for row, (_, stream) in zip(lengths, joint, strict=True):
        own = stream.head.codes[0][GREEN].lengths
        row[list(own)] = list(own.values())
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    ranked = np.take_along_axis(lengths, order, axis=1)
    room = np.where(ranked > 0, 1 << MOST_BITS - ranked, 0)
    table = np.repeat((order << 4 | ranked).astype(np.int16).ravel(), room.ravel()).reshape(n, size)[:, _REVERSED].ravel()

    streams = [s.bits.raw[s.bits.at >> 3 :] for _, s in joint]
    sizes = np.array([len(x) for x in streams])
    raw = np.frombuffer(b"".join(streams), dtype=np.uint8).astype(np.uint32)
    wide = raw.copy()
    wide[:-1] |= raw[1:] << np.uint32(8)
    wide[:-2] |= raw[2:] << np.uint32(16)
    windows = ((wide[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(size - 1)).astype(np.int32)
    windows += np.repeat(np.arange(n, dtype=np.int32) * size, sizes)[:, None]
    found = table[windows.ravel()]
    del windows
    last = len(found) - 1
    step = np.minimum(np.arange(len(found), dtype=np.int32) + (found & 15), last)
    two = step[step]
    four = two[two]
    eight = memoryview(four[four])
    starts: list[int] = []
    begins = (np.cumsum(sizes) - sizes) * 8
    counts = np.array([s.width * s.height for _, s in joint])
    for begin, (_, stream), count in zip(begins.tolist(), joint, counts.tolist(), strict=True):
        p = begin + (stream.bits.at & 7)
        for _ in range(-(-count // 8)):
            starts.append(p)
            p = eight[p]
    at = np.empty((len(starts), 8), dtype=np.int32)
    at[:, 0] = starts
    for i in range(1, 8):
        at[:, i] = step[at[:, i - 1]]
    samples = (found[at.ravel()] >> 4).astype(np.uint8).tobytes()
    rows = -(-counts // 8) * 8
    for (i, _), begin, count in zip(joint, (np.cumsum(rows) - rows).tolist(), counts.tolist(), strict=True):
        out[i] = samples[begin : begin + count]
    return out


# Columns

UNIT = 576
_MOST_ROWS = 1 << 14
#: Texts that deflate below this share of their size are stored with back-references.
REPETITIVE = 0.15


def store_texts(texts: pa.Array) -> tuple[list[bytes], list[int]]:
    """A file for each text, and the bytes of its payload: UTF-8, then 255s up to a positive multiple of ``UNIT``.

    Samples are grey pixels, ``UNIT`` a row (a multiple of it for payloads of over 2**14 rows).
    """
    raw, bounds = flat_bytes(texts)
    sizes = np.diff(bounds)
    rows = np.maximum(1, -(-sizes // UNIT))
    padded = rows * UNIT
    ends = np.cumsum(padded)
    samples = np.full(int(ends[-1]) if len(ends) else 0, 255, dtype=np.uint8)
    samples[np.arange(len(raw)) + np.repeat(ends - padded - bounds[:-1], sizes)] = raw
    files: list[bytes | None] = [None] * len(sizes)
    plain: list[int] = []
    for i, (a, n, r) in enumerate(zip((ends - padded).tolist(), padded.tolist(), rows.tolist(), strict=True)):
        one = samples[a : a + n]
        if r > _MOST_ROWS or len(zlib.compress(one, 1)) < REPETITIVE * n:
            times = -(-r // _MOST_ROWS)
            grey = np.full(-(-r // times) * times * UNIT, 255, dtype=np.uint32)
            grey[:n] = one
            pixels = (grey * np.uint32(0x010101) | np.uint32(0xFF000000)).reshape(-1, times * UNIT)
            distinct = len(np.unique(one))
            files[i] = encode(pixels, (PALETTE,) if distinct <= 16 else (SUBTRACT_GREEN,), lz=True, cache_bits=4 if distinct > 16 else 0)
        else:
            plain.append(i)
    if plain:
        parts = [samples[ends[i] - padded[i] : ends[i]] for i in plain]
        cut = np.concatenate([[0], np.cumsum(padded[plain])])
        for i, x in zip(plain, encode_grey(np.concatenate(parts).astype(np.int64), cut, UNIT, rows[plain]), strict=True):
            files[i] = x
    return files, padded.tolist()


def store_media(df: DataFrame, text_col: str = "text", out: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) with each text as a lossless WebP file and ``n_bytes``, its length in UTF-8.

    Null is stored as the empty text.  Equal texts give equal files.  New columns replace
    kept ones of their names.
    """
    names = [c for c in (df.columns if keep is None else keep) if c not in (out, "n_bytes")]
    given = df.select(*[df[f"`{c}`"] for c in names], df[f"`{text_col}`"].alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch["__text"], 1_000_000):
                part = batch.slice(a, b - a)
                files, _ = store_texts(part["__text"])
                sizes = np.diff(flat_bytes(part["__text"])[1])
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [f.name for f in schema.fields])

    return given.mapInArrow(run, schema)


def read_media(df: DataFrame, media_col: str = "media", out: str = "samples") -> DataFrame:
    """``df`` with the grey samples of each file, row by row, and its ``feature``: size, transforms, tokens' kinds and brightness."""
    names = [c for c in df.columns if c not in (out, "feature")]
    given = df.select(*[df[f"`{c}`"] for c in names])
    schema = T.StructType([*given.schema.fields, T.StructField(out, T.BinaryType()), T.StructField("feature", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch[media_col], 600_000):
                part = batch.slice(a, b - a)
                files = part[media_col].to_pylist()
                samples = decode_grey(files)
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(samples, pa.binary()), pa.array([feature(f, s) for f, s in zip(files, samples, strict=True)])], [f.name for f in schema.fields])

    return given.mapInArrow(run, schema)


def feature(raw: bytes, samples: bytes) -> str:
    """Width and height of a file and mean and distinct values of its samples."""
    size = int.from_bytes(raw[21:25], "little")
    values = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(values, minlength=256)
    return f"{(size & 16383) + 1}x{(size >> 14 & 16383) + 1} mean={int(counts @ np.arange(256)) * 1000 // len(values)} distinct={np.count_nonzero(counts)}"


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the encoder and decoder."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = read_media(store_media(docs, keep=["doc_id"]))
    length = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / UNIT)).cast("int") * UNIT
    both = both.withColumn("payload", F.substring("samples", F.lit(1), length))
    return both.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", length - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

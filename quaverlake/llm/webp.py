"""Lossless WebP (VP8L): a reader of the whole format, and a writer to store payloads with.

The reader decodes prefix codes, back-references and the colour cache, then inverts the predictor, cross-colour, subtract-green
and palette transforms, for any number of prefix groups. In images whose pixels differ in green alone, as palette images do, all places of
the stream are looked up in the prefix code at once, as arrays, and only the way from symbol to symbol is walked.

Stored texts use the format: a payload's bytes are the grey samples of opaque pixels, 64 in a row, with wider rows from 16384 rows on;
what a last wide row lacks is filled with zeros and cut off again by the payload's length. Subtract-green and the palette transform leave one channel, whose repeats of
twelve samples or more become back-references; symbols, distances and the palette have Huffman codes. Repeats are searched within segments, so memory does not follow the text.
Payloads above 2**28 bytes have four samples a pixel and codes of one length. `encode_rich` writes any transforms, for tests and other images.

Defined results: a null or empty text is a payload of 64 zero bytes. Equal texts give equal values. One row per input row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SIDE = 16384
SEGMENT = 1 << 20
#: Bytes of a payload that are grey samples; above, pixels hold four.
MOST_GREY = 1 << 28
#: Bytes of a stream whose places are looked up at once.
WINDOW = 1 << 14
EIGHT = np.arange(8, dtype=np.uint32)
#: The order of code length codes, and the neighbours (x to the left, y up) that the first 120 distances stand for.
ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEIGHBOURS = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Reads numbers of at most 32 bits from the low bits up."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data) + 64
        self.base, self.held = 0, int.from_bytes(data[:64], "little")  # 64 bytes from bit `base` on

    def peek(self, n: int) -> int:
        skip = self.at - self.base
        if not 0 <= skip <= 480:
            self.base, skip = self.at & ~7, self.at & 7
            self.held = int.from_bytes(self.data[self.base >> 3 : (self.base >> 3) + 64], "little")
        return self.held >> skip & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.size:
            raise ValueError("the stream ends early")
        return value


@lru_cache
def _turned(size: int) -> np.ndarray:
    """All numbers of `size` bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(size):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


class Code:
    """A canonical prefix code from its lengths; one symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if len(used) <= 1:
            self.size, self.symbols = 0, used if len(used) else np.zeros(1, np.int64)
            self.lengths = np.zeros(1, np.int64)
        else:
            own = lengths[used]
            order = own.argsort(kind="stable")
            self.symbols, self.lengths = used[order], own[order]
            self.size = int(self.lengths[-1])
            if (1 << self.size >> self.lengths).sum() != 1 << self.size:
                raise ValueError("code lengths do not fill the code space")
        self.equal = self.size == int(self.lengths[0])
        self.table: list[int] | None = None

    def steps(self) -> np.ndarray:
        """For each number of `size` bits: 16 * the symbol that it starts with + the symbol's length."""
        return np.repeat(self.symbols << 4 | self.lengths, 1 << self.size >> self.lengths)[_turned(self.size)]

    def read(self, bits: Bits) -> int:
        if self.table is None:
            self.table = self.steps().tolist()
        step = self.table[bits.peek(self.size) if self.size else 0]
        bits.at += step & 15
        return step >> 4


@lru_cache(1024)
def _simple(first: int, second: int) -> Code:
    lengths = np.zeros(256, np.int64)
    lengths[[first, second]] = 1
    return Code(lengths)


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        return _simple(first, bits.read(8) if two else first)
    lengths, own = np.zeros(alphabet, np.int64), [0] * 19
    for i in range(4 + bits.read(4)):
        own[ORDER[i]] = bits.read(3)
    code = Code(np.array(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    i, before = 0, 8
    while i < alphabet and left:
        left -= 1
        x = code.read(bits)
        if x < 16:
            lengths[i] = x
            i += 1
            before = x or before
        else:
            n = 3 + bits.read(2) if x == 16 else 3 + bits.read(3) if x == 17 else 11 + bits.read(7)
            if i + n > alphabet:
                raise ValueError("too many code lengths")
            if x == 16:
                lengths[i : i + n] = before
            i += n
    return Code(lengths)


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    more = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << more) + bits.read(more) + 1


def _unshifted(data: bytes, at: int, n: int) -> np.ndarray:
    """n bits from bit `at` on, as bytes."""
    shift = at & 7
    raw = np.frombuffer(data, np.uint8)[at >> 3 : (at + n + 7) >> 3].astype(np.uint16)
    high = np.append(raw[1:], np.uint16(0))
    return ((raw >> shift | high << (8 - shift)) & 0xFF).astype(np.uint8)


def _flat(bits: Bits, group: list[Code], n: int) -> np.ndarray:
    """Pixels whose four codes have constant lengths."""
    sizes = [c.size for c in group[:4]]
    total = sum(sizes)
    out = np.zeros((n, 4), np.uint8)  # in the order of the stream: green, red, blue, alpha
    if total == 0:
        out[:] = [c.symbols[0] for c in group[:4]]
    elif bits.at + n * total > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    else:
        for i in range(0, n, SEGMENT):
            k = min(SEGMENT, n - i)
            raw = np.unpackbits(_unshifted(bits.data, bits.at, k * total), bitorder="little", count=k * total).reshape(k, total)
            at = 0
            for channel, (size, code) in enumerate(zip(sizes, group, strict=False)):
                index = np.zeros(k, np.uint8)
                for b in range(size):
                    index = index << 1 | raw[:, at + b]
                at += size
                out[i : i + k, channel] = code.symbols[index]
            bits.at += k * total
    return out[:, [2, 0, 1, 3]].copy().view("<u4").ravel()


def _green_only(bits: Bits, group: list[Code], n: int, width: int) -> np.ndarray:
    """Pixels that differ in green alone.

    For every bit of a window: the symbol that would start there and, by doubling, the place after the next 1, 2, 4, 8 and 16 literals, at most up to a
    back-reference. The walk then takes 16 literals a step, and the literals on it are gathered as arrays."""
    green, far = group[0], group[4]
    steps, mask, size = green.steps().astype(np.int32), (1 << green.size) - 1, len(bits.data)
    literals, copies, i = [], [], 0
    while i < n:
        first, count = bits.at >> 3, min(WINDOW, size - (bits.at >> 3))
        if count <= 0:
            raise ValueError("the stream ends early")
        raw = np.zeros(count + 2, np.uint32)
        near = np.frombuffer(bits.data, np.uint8, min(count + 2, size - first), first)
        raw[: len(near)] = near
        wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        step = steps[(wide[:, None] >> EIGHT & mask).ravel()]
        end = len(step)
        literal = step < 4096
        # Back-references and places behind the window stand for themselves.
        jump, taken = np.arange(end + 15, dtype=np.int32), np.zeros(end + 15, np.uint8)
        jump[:end] += (step & 15) * literal
        taken[:end] = literal
        levels = [jump]
        for _ in range(4):
            taken = taken + taken[jump]
            jump = jump[jump]
            levels.append(jump)
        far_on, many, what, base, at, starts = memoryview(jump), memoryview(taken), memoryview(step), 8 * first, bits.at - 8 * first, []
        while i < n and at < end:
            starts.append(at)
            i += many[at]
            at = far_on[at]
            if at >= end or i >= n or what[at] < 4096:
                continue
            s = what[at]
            bits.at = base + at + (s & 15)
            length = _extra(bits, (s >> 4) - 256)
            place = _extra(bits, far.read(bits))
            x, y = NEIGHBOURS[place - 1] if place <= 120 else (place - 120, 0)
            distance = max(1, x + y * width)
            if distance > i or i + length > n:
                raise ValueError("back-reference out of the image")
            copies.append((i, length, distance))
            i += length
            at = bits.at - base
        walked = np.array(starts, np.int32)
        for level in levels[3::-1]:
            walked = np.stack([walked, level[walked]], 1).ravel()
        walked = walked[walked < end]
        walked = walked[literal[walked]]
        literals.append((step[walked] >> 4).astype(np.uint8))
        stops = base + walked + (step[walked] & 15)
        bits.at = base + at
    out = np.zeros(n, np.uint8)
    own = np.ones(n, bool)
    for at, length, _ in copies:
        own[at : at + length] = False
    spare = sum(map(len, literals)) - int(own.sum())  # the last step may pass the image's end
    if spare < len(stops) and stops[-1 - spare] > 8 * size:
        raise ValueError("the stream ends early")
    out[own] = np.concatenate(literals)[: len(own) - sum(length for _, length, _ in copies)]
    for at, length, distance in copies:
        out[at : at + length] = out[at - distance : at - distance + length] if distance >= length else np.resize(out[at - distance : at], length)
    red, blue, alpha = (int(c.symbols[0]) for c in group[1:4])
    return out.astype(np.uint32) << 8 | np.uint32(alpha << 24 | red << 16 | blue)


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, by rows."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        down = (height + (1 << block) - 1) >> block
        meta = (_pixels(bits, across, down, False) >> 8 & 0xFFFF).reshape(down, across)
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[_read_code(bits, a) for a in (280 + cache_size, 256, 256, 256, 40)] for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    n = width * height
    if meta is None and not cache_bits:
        if all(c.equal for c in groups[0][:4]) and groups[0][0].symbols.max() < 256:
            return _flat(bits, groups[0], n)
        if main and not any(c.size for c in groups[0][1:4]):
            return _green_only(bits, groups[0], n, width)
    out, cache, i, seen = [0] * n, [0] * cache_size, 0, 0
    group = groups[0]
    shift = 32 - cache_bits
    while i < n:
        if meta is not None:
            group = groups[int(meta[i // width >> block, i % width >> block])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) if c.size else int(c.symbols[0]) for c in group[1:4])
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            code = _extra(bits, group[4].read(bits))
            x, y = NEIGHBOURS[code - 1] if code <= 120 else (code - 120, 0)
            distance = max(1, x + y * width)
            if distance > i or i + length > n:
                raise ValueError("back-reference out of the image")
            for _ in range(length):
                out[i] = out[i - distance]
                i += 1
        else:
            out[i] = cache[s - 280]
            i += 1
        if cache_bits:
            for p in out[seen:i]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            seen = i
    return np.array(out, np.uint32)


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    to_left, to_top = np.abs(top - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
    return np.where(to_left < to_top, left, top)


def _half(a, corner):
    d = a - corner
    return np.clip(a + np.sign(d) * (np.abs(d) >> 1), 0, 255)


#: Predictors by mode from left, top, top right and top left, on channels as integers.
PREDICTORS = [
    lambda l, t, r, c: np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(t)), lambda l, t, r, c: l, lambda l, t, r, c: t, lambda l, t, r, c: r, lambda l, t, r, c: c,
    lambda l, t, r, c: _average(_average(l, r), t), lambda l, t, r, c: _average(l, c), lambda l, t, r, c: _average(l, t), lambda l, t, r, c: _average(c, t), lambda l, t, r, c: _average(t, r),
    lambda l, t, r, c: _average(_average(l, c), _average(t, r)), lambda l, t, r, c: _select(l, t, c), lambda l, t, r, c: np.clip(l + t - c, 0, 255), lambda l, t, r, c: _half(_average(l, t), c),
]
NEEDS_LEFT = {1, 5, 6, 7, 10, 11, 12, 13}


def _channels(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4).astype(np.int64)


def _joined(channels: np.ndarray) -> np.ndarray:
    return (channels & 255).astype(np.uint8).reshape(-1, 4).view("<u4").ravel()


def _modes(modes: np.ndarray, block: int, width: int, height: int) -> np.ndarray:
    across = (width + (1 << block) - 1) >> block
    return modes.reshape(-1, across)[np.arange(height)[:, None] >> block, np.arange(width)[None] >> block]


def _predicted(image: np.ndarray, y: int, x: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """The prediction of pixels x of row y from the finished pixels of image. The last pixel's top right is the first of its own row."""
    width = image.shape[1]
    flat = image.reshape(-1, 4)
    at = y * width + x
    left, top, right, corner = flat[at - 1], flat[at - width], flat[at - width + 1], flat[at - width - 1]
    out = np.empty((len(x), 4), np.int64)
    for m in set(mode.tolist()):
        own = mode == m
        out[own] = PREDICTORS[m](left[own], top[own], right[own], corner[own])
    return out


def _unpredict(pixels: np.ndarray, modes: np.ndarray, block: int, width: int, height: int) -> np.ndarray:
    image = _channels(pixels).reshape(height, width, 4)
    image[0, 0] = (image[0, 0] + [0, 0, 0, 255]) & 255
    image[0] = np.cumsum(image[0], axis=0) & 255
    each = _modes((modes >> 8 & 0xFF) % 16, block, width, height)
    each = np.where(each > 13, 0, each)
    for y in range(1, height):
        image[y, 0] = (image[y, 0] + image[y - 1, 0]) & 255
        row = each[y]
        x = 1
        while x < width:
            end = x + 1
            while end < width and (row[end] in NEEDS_LEFT) == (row[x] in NEEDS_LEFT) and (row[end] == row[x] or row[x] not in NEEDS_LEFT):
                end += 1
            if row[x] == 1:
                image[y, x:end] = (image[y, x - 1] + np.cumsum(image[y, x:end], axis=0)) & 255
            elif row[x] in NEEDS_LEFT:
                for k in range(x, end):
                    image[y, k] = (image[y, k] + _predicted(image, y, np.array([k]), row[k : k + 1])[0]) & 255
            else:
                image[y, x:end] = (image[y, x:end] + _predicted(image, y, np.arange(x, end), row[x:end])) & 255
            x = end
    return _joined(image)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ 128) - 128


def _cross(pixels: np.ndarray, elements: np.ndarray, block: int, width: int, height: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what green says of red, and green and red of blue."""
    c = _channels(pixels)
    e = _signed(_channels(_modes(elements, block, width, height).ravel()))
    green, red = _signed(c[:, 1]), c[:, 2].copy()
    new_red = (red + sign * (e[:, 0] * green >> 5)) & 255
    true_red = _signed(new_red if sign == 1 else red)
    c[:, 0] = (c[:, 0] + sign * ((e[:, 1] * green >> 5) + (e[:, 2] * true_red >> 5))) & 255
    c[:, 2] = new_red
    return _joined(c)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) green to red and blue, or takes it away (-1)."""
    pixels = pixels.astype(np.uint32)
    green = pixels >> 8 & 0xFF
    if sign < 0:
        green = 256 - green & 0xFF
    return pixels & np.uint32(0xFF00FF00) | (pixels & np.uint32(0x00FF00FF)) + (green << 16 | green) & np.uint32(0x00FF00FF)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(pixels: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    pack = _packing(len(palette))
    index = (pixels >> 8 & 0xFF).reshape(height, -1)
    if pack:
        size = 8 >> pack
        index = (index[:, :, None] >> (np.arange(1 << pack) * size) & ((1 << size) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index.ravel()]


def decode(data: bytes) -> np.ndarray:
    """A WebP file's ARGB pixels, rows by columns."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while data[at : at + 4] != b"VP8L":
        if at + 8 > end:
            raise ValueError("no lossless image")
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + (size & 1)
    bits = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    full, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [u[0] for u in undo]:
            raise ValueError("transform used twice")
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            across, down = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            undo.append((kind, width, block, _pixels(bits, across, down, False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = _joined(np.cumsum(_channels(_pixels(bits, n, 1, False)), axis=0))
            undo.append((kind, width, 0, palette))
            width = (width + (1 << _packing(n)) - 1) >> _packing(n)
        else:
            undo.append((kind, width, 0, None))
    pixels = _pixels(bits, width, height, True)
    for kind, width, block, more in reversed(undo):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, more, block, width, height)
        elif kind == CROSS:
            pixels = _cross(pixels, more, block, width, height, 1)
        elif kind == GREEN:
            pixels = _green(pixels, 1)
        else:
            pixels = _unpalette(pixels, more, width, height)
    if not alpha:
        pixels = pixels | np.uint32(0xFF000000)
    return pixels.reshape(height, full)


class Out:
    """Collects numbers from the low bits up."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _put_lengths(out: Out, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code by its lengths and gives each symbol's bits and their number."""
    used = lengths.nonzero()[0]
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        out.put(5, 3)
        out.put(int(used[0]) if len(used) else 0, 8)
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if len(used) == 2 and used[1] < 256 and lengths[used].tolist() == [1, 1]:
        out.put(7, 3)
        out.put(int(used[0]), 8)
        out.put(int(used[1]), 8)
        return _codes(lengths)
    runs: list[tuple[int, int, int]] = []  # symbol, extra, bits of extra
    edge = [0, *((lengths[1:] != lengths[:-1]).nonzero()[0] + 1).tolist(), len(lengths)]
    before = 8
    for begin, end, x in zip(edge, edge[1:], lengths[edge[:-1]].tolist(), strict=False):
        n = end - begin
        while n:
            if x == 0 and n >= 11:
                k = min(n, 138)
                runs.append((18, k - 11, 7))
            elif x == 0 and n >= 3:
                k = min(n, 10)
                runs.append((17, k - 3, 3))
            elif x and x == before and n >= 3:
                k = min(n, 6)
                runs.append((16, k - 3, 2))
            else:
                k = 1
                runs.append((x, 0, 0))
                before = x or before
            n -= k
    own = _lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    out.put(0, 1)
    count = max(4, 1 + max(ORDER.index(s) for s in own.nonzero()[0].tolist()))
    out.put(count - 4, 4)
    for s in ORDER[:count]:
        out.put(int(own[s]), 3)
    out.put(0, 1)
    bits, sizes = (x.tolist() for x in _codes(own))
    for s, extra, n in runs:
        out.put(bits[s] | extra << sizes[s], sizes[s] + n)
    return _codes(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra, bits of extra) of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, v & ((1 << (n - 1)) - 1), n - 1


def _put_pixels(out: Out, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, back: bool = False) -> None:
    """An entropy-coded image with Huffman codes, and if asked for a colour cache and back-references."""
    px = pixels.tolist()
    cache, recent, steps, i = {}, {}, [], 0
    while i < len(px):
        p, n = px[i], 0
        if back and i and i + 3 <= len(px):
            key = tuple(px[i : i + 3])
            j = recent.get(key, -1)
            if j >= 0:
                while i + n < len(px) and n < 4096 and px[j + n] == px[i + n]:
                    n += 1
        slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
        if n >= 3:
            d = i - j
            near = next((k for k, (x, y) in enumerate(NEIGHBOURS) if max(1, x + y * width) == d), None)
            steps.append(("copy", _prefix(n), _prefix(near + 1 if near is not None else d + 120)))
        elif cache_bits and cache.get(slot, 0) == p:
            steps.append(("cache", slot))
            n = 1
        else:
            steps.append(("pixel", p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24))
            n = 1
        for k in range(i, i + n):
            if cache_bits:
                cache[(CACHE_FACTOR * px[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]
            recent[tuple(px[k : k + 3])] = k
        i += n
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    counts = [Counter() for _ in range(5)]
    for s in steps:
        if s[0] == "pixel":
            for c, x in zip(counts, s[1:], strict=False):
                c[x] += 1
        elif s[0] == "cache":
            counts[0][280 + s[1]] += 1
        else:
            counts[0][256 + s[1][0]] += 1
            counts[4][s[2][0]] += 1
    codes = []
    for c, size in zip(counts, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True):
        bits, sizes = _put_lengths(out, _lengths(np.array([c[s] for s in range(size)], np.int64)))
        codes.append(list(zip(bits.tolist(), sizes.tolist(), strict=True)))
    for s in steps:
        if s[0] == "pixel":
            for code, x in zip(codes, s[1:], strict=False):
                out.put(*code[x])
        elif s[0] == "cache":
            out.put(*codes[0][280 + s[1]])
        else:
            out.put(*codes[0][256 + s[1][0]])
            out.put(s[1][1], s[1][2])
            out.put(*codes[4][s[2][0]])
            out.put(s[2][1], s[2][2])


def _file(bits: bytes) -> bytes:
    pad = b"\0" * (len(bits) & 1)
    return b"RIFF" + (12 + len(bits) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(bits).to_bytes(4, "little") + bits + pad


def _start(width: int, height: int) -> Out:
    out = Out()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def encode_rich(image: np.ndarray, transforms: list[tuple], cache_bits: int = 0, back: bool = True) -> bytes:
    """A file with these transforms, in order: (PREDICTOR, block, modes), (CROSS, block, elements), (GREEN,) or (PALETTE,).
    Modes and elements are pixels of the transforms' own images."""
    height, width = image.shape
    pixels, out = image.ravel().astype(np.uint32), _start(width, height)
    for kind, *more in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == GREEN:
            pixels = _green(pixels, -1)
        elif kind == PALETTE:
            palette, index = np.unique(pixels, return_inverse=True)
            out.put(len(palette) - 1, 8)
            steps = _joined(np.diff(_channels(palette), axis=0, prepend=0))
            _put_pixels(out, steps, len(steps), False)
            pack = _packing(len(palette))
            wide = (width + (1 << pack) - 1) >> pack
            cells = np.zeros((height, wide << pack), np.uint32)
            cells[:, :width] = index.reshape(height, width)
            cells = (cells.reshape(height, wide, 1 << pack) << (np.arange(1 << pack) * (8 >> pack)).astype(np.uint32)).sum(axis=2).astype(np.uint32)
            pixels, width = (cells << 8 | np.uint32(0xFF000000)).ravel(), wide
        else:
            block, own = more
            across = (width + (1 << block) - 1) >> block
            out.put(block - 2, 3)
            _put_pixels(out, own, across, False)
            if kind == CROSS:
                pixels = _cross(pixels, own, block, width, height, -1)
            else:
                true = _channels(pixels).reshape(height, width, 4)
                modes = _modes(own >> 8 & 0xFF, block, width, height)
                rest = true.copy()
                rest[0, 1:] -= true[0, :-1]
                rest[0, 0] -= [0, 0, 0, 255]
                for y in range(1, height):
                    rest[y, 0] -= true[y - 1, 0]
                    if width > 1:
                        rest[y, 1:] -= _predicted(true, y, np.arange(1, width), modes[y, 1:])
                pixels = _joined(rest)
    out.put(0, 1)
    _put_pixels(out, pixels, width, True, cache_bits, back)
    return _file(out.value.to_bytes((out.n + 7) // 8, "little"))


_heads: dict[bytes, tuple[int, int]] = {}


def _equal_codes(present: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(bits, their number, code size, code of each byte) of the four equal codes, and of no distances."""
    symbols = np.flatnonzero(present)
    size = max(0, int(len(symbols) - 1).bit_length())
    chosen = present.copy()
    spare = np.flatnonzero(~present)[: (1 << size) - len(symbols)]
    chosen[spare] = True
    key = np.packbits(chosen).tobytes()
    if key not in _heads:
        if len(_heads) > 4096:
            _heads.clear()
        out = Out()
        out.put(0, 3)  # no more transforms, no colour cache, no prefix groups
        lengths = np.where(chosen, max(size, 1), 0)
        for more in (24, 0, 0, 0):
            _put_lengths(out, np.append(lengths, np.zeros(more, np.int64)))
        _put_lengths(out, np.zeros(40, np.int64))
        _heads[key] = out.value, out.n
    rank = np.zeros(256, np.uint8)
    rank[chosen] = np.arange(int(chosen.sum()))
    return *_heads[key], size, rank


def encode(image: np.ndarray) -> bytes:
    """A file whose samples all have codes of one length."""
    height, width = image.shape
    samples = np.ascontiguousarray(image.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]].ravel()
    value, n, size, rank = _equal_codes(np.bincount(samples, minlength=256) > 0)
    out = _start(width, height)
    out.put(value, n)
    head, shift = out.value, out.n & 7
    start = head.to_bytes((out.n + 7) // 8, "little")
    parts = []
    if size:
        for i in range(0, len(samples), SEGMENT):
            index = rank[samples[i : i + SEGMENT]]
            bits = np.empty((len(index), size), np.uint8)
            for b in range(size):
                bits[:, b] = index >> (size - 1 - b) & 1
            parts.append(np.packbits(bits.ravel(), bitorder="little"))
    body = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if shift and len(body):
        wide = np.append(body, np.uint8(0)).astype(np.uint16) << shift
        wide[1:] |= body.astype(np.uint16) >> (8 - shift)
        body = (wide & 0xFF).astype(np.uint8)
        first = bytes([start[-1] | int(body[0])])
        return _file(start[:-1] + first + body[1:].tobytes())
    return _file(start + body.tobytes())


@lru_cache
def _near(width: int) -> dict[int, int]:
    """The smallest code of each distance that a neighbour stands for."""
    out: dict[int, int] = {}
    for code, (x, y) in enumerate(NEIGHBOURS, 1):
        out.setdefault(max(1, x + y * width), code)
    return out


def _lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths; a symbol alone gets length 1."""
    used = counts.nonzero()[0]
    out = np.zeros(len(counts), np.int64)
    weights = counts[used].tolist()
    if len(used) < 2:
        out[used] = 1
        return out
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        above, new = [0] * (2 * len(weights) - 1), len(weights)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heap[0]
            above[i] = above[j] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = [0] * new
        for i in range(new - 2, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth) <= limit:
            out[used] = depth[: len(weights)]
            return out
        weights = [w // 2 + 1 for w in weights]


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's bits, the first one lowest, and their number."""
    code = Code(lengths)
    bits, sizes = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if code.size:
        room = 1 << code.size >> code.lengths
        bits[code.symbols], sizes[code.symbols] = _turned(code.size)[np.cumsum(room) - room], code.lengths
    return bits, sizes


def _repeats(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of repeats of at least 12 samples, the nearest found, from left to right."""
    if len(x) < 16:
        return []
    two = x[:-1].astype(np.uint64) | x[1:].astype(np.uint64) << 8
    four = two[:-2] | two[2:] << 16
    eight = four[:-4] | four[4:] << 32
    order = ((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16).argsort(kind="stable")
    same = eight[order[1:]] == eight[order[:-1]]
    distance = np.zeros(len(eight) + 1, np.int64)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    edge = (distance[1:] != distance[:-1]).nonzero()[0] + 1
    ends, out, done = edge.tolist(), [], 0
    for begin, end, d in zip(ends, ends[1:], distance[edge[:-1]].tolist(), strict=False):
        begin = max(begin, done)
        if d and end - begin > 4:
            done = end + 7
            while begin < done:
                n = min(4096, done - begin)
                out.append((begin, n, d))
                begin += n
    return out


def _tokens(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of green by turns, and of the repeats among them: their places and (bits of length, their number, distance symbol, bits, number)."""
    found = _repeats(x)
    symbols, shown = x.astype(np.int64), np.ones(len(x), bool)
    more = np.zeros((len(found), 5), np.int64)
    near = _near(width)
    for k, (at, n, d) in enumerate(found):
        symbol, *length = _prefix(n)
        more[k] = (*length[:2], *_prefix(near.get(d) or d + 120))
        shown[at : at + n] = False
        shown[at], symbols[at] = True, 256 + symbol
    place = np.flatnonzero(shown)
    return symbols[place], np.searchsorted(place, [f[0] for f in found]), more


def _spread(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits of numbers, one after another."""
    ends = np.cumsum(sizes)
    return ((np.repeat(values, sizes) >> (np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes))) & 1).astype(np.uint8)


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A file of grey, opaque pixels: subtract-green, palette, back-references and Huffman codes."""
    height = len(samples) // width
    out = _start(width, height)
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    rank = np.zeros(256, np.uint8)
    rank[colours] = np.arange(len(colours))
    for value, n in ((1, 1), (GREEN, 2), (1, 1), (PALETTE, 2), (len(colours) - 1, 8), (0, 1)):
        out.put(value, n)
    steps = np.append(colours[0], colours[1:] - colours[:-1])
    bits, sizes = _put_lengths(out, _lengths(np.bincount(steps, minlength=280)))
    # Red and blue are 0 throughout. Alpha is 255, then steps of 0: a code of two symbols, or one if there is one colour. No distances.
    out.put(5 | 5 << 11, 22)
    out.put(*((7 | 255 << 11, 19) if len(steps) > 1 else (5 | 255 << 3, 11)))
    out.put(5, 11)
    for k, (low, size) in enumerate(zip(bits[steps].tolist(), sizes[steps].tolist(), strict=True)):
        out.put(low | (k == 0 < len(steps) - 1) << size, size + (len(steps) > 1))
    out.put(0, 3)  # no more transforms, no colour cache, no prefix groups
    index, pack = rank[samples], _packing(len(colours))
    if pack:
        wide = (width + (1 << pack) - 1) >> pack
        cells = np.zeros((height, wide << pack), np.uint8)
        cells[:, :width] = index.reshape(height, width)
        index, width = (cells.reshape(height, wide, 1 << pack) << (np.arange(1 << pack) * (8 >> pack)).astype(np.uint8)).sum(axis=2, dtype=np.uint8).ravel(), wide
    parts = [index[i : i + SEGMENT] for i in range(0, len(index), SEGMENT)]
    tokens = [_tokens(parts[0], width)] if len(parts) == 1 else (_tokens(x, width) for x in parts)
    counts, far = np.zeros(280, np.int64), np.zeros(40, np.int64)
    for symbols, _, more in tokens:
        counts += np.bincount(symbols, minlength=280)
        far += np.bincount(more[:, 2], minlength=40)
    bits, sizes = _put_lengths(out, _lengths(counts))
    out.put(5 | 5 << 11 | 5 << 22, 33)
    far_bits, far_sizes = _put_lengths(out, _lengths(far))
    rest = np.array([out.value >> i & 1 for i in range(out.n & ~7, out.n)], np.uint8)
    body = [(out.value & ((1 << (out.n & ~7)) - 1)).to_bytes(out.n >> 3, "little")]
    for symbols, at, more in tokens if len(parts) == 1 else (_tokens(x, width) for x in parts):
        values, lengths = np.zeros((len(symbols), 4), np.int64), np.zeros((len(symbols), 4), np.int64)
        values[:, 0], lengths[:, 0] = bits[symbols], sizes[symbols]
        values[at, 1], lengths[at, 1], values[at, 3], lengths[at, 3] = more[:, 0], more[:, 1], more[:, 3], more[:, 4]
        values[at, 2], lengths[at, 2] = far_bits[more[:, 2]], far_sizes[more[:, 2]]
        rest = np.concatenate([rest, _spread(values.ravel(), lengths.ravel())])
        whole = len(rest) & ~7
        body.append(np.packbits(rest[:whole], bitorder="little").tobytes())
        rest = rest[whole:]
    return _file(b"".join([*body, np.packbits(rest, bitorder="little").tobytes()]))


def to_image(payload: bytes) -> np.ndarray:
    """Rows of 16 pixels of four bytes, or of more where 16384 rows would not do."""
    rows = len(payload) // 64
    width = 16 * max(1, -(-rows // SIDE))
    height = -(-len(payload) // (4 * width))
    if width > SIDE:
        raise ValueError("more than a gibibyte in one image")
    return np.frombuffer(payload.ljust(4 * width * height, b"\0"), "<u4").reshape(height, width)


def stored(payload: bytes) -> bytes:
    if len(payload) > MOST_GREY:
        return encode(to_image(payload))
    width = 64 * max(1, -(-(len(payload) // 64) // SIDE))
    return encode_grey(np.frombuffer(payload.ljust(-(-len(payload) // width) * width, b"\0"), np.uint8), width)


def loaded(media: bytes, size: int) -> bytes:
    pixels = decode(media)
    if size > MOST_GREY:
        return pixels.astype("<u4").tobytes()[:size]
    return pixels.astype(np.uint8).tobytes()[:size]


def feature(payload: bytes) -> str:
    """Size, mean, deviation, distinct samples and mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    mean = float(count @ np.arange(256)) / len(x)
    deviation = max(0.0, float(count @ (np.arange(256) ** 2)) / len(x) - mean * mean) ** 0.5
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) / max(1, len(x) - 1)
    return f"{len(x) // 64}|{mean:.3f}|{deviation:.3f}|{int((count > 0).sum())}|{step:.3f}"


def _store(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "media"]
    for batch in batches:
        rows, size = [], 0
        for i, t in zip(batch.column("id"), batch.column("text"), strict=True):
            raw = (t.as_py() or "").encode()
            rows.append((i.as_py(), len(raw), stored(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))))
            size += len(rows[-1][2])
            if size > limit:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names)


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "feature")}
        for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            payload = loaded(media.as_py(), max(64, -(-n // 64) * 64))
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["feature"].append(feature(payload))
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out.values())], [*batch.schema.names, *out])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's WebP file."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "id long, n_bytes long, media binary")


def inspect_media(media: DataFrame) -> DataFrame:
    """The rows of store_texts with what is read back from the files."""
    return media.mapInArrow(_inspect, "id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op6_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inspect_media(store_texts(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")

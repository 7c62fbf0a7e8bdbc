"""Vectorised words of UTF-8 text: boundaries and Rabin-Karp hashes over whole Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Numpy works on the bytes of
many texts at once; texts are handed over in slices of bounded size, so memory does not
follow the batch, and one long text is hashed piece by piece.

A word's hash is that of two polynomials modulo different primes of 31 bits; powers of two as modulus, which arithmetic would give for free,
let anyone make different words with equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text that are hashed at once; about 60 bytes of working memory each.
PIECE = 1 << 19

#: Prime moduli and bases of a word's two hashes, and the factor between the words of a window.
FIELDS = ((2147483647, 1103515249), (2147483629, 1664525911))
BASE = 0x9E3779B97F4A7C15 | 1
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(field: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a field's base and of its inverse, as many as a piece needs; those of longer words are not kept."""
    if field in _pow and len(_pow[field][0]) >= n:
        return _pow[field]
    modulus, base = FIELDS[field]
    out = []
    for x in (base, pow(base, -1, modulus)):
        p = np.ones(1, np.uint64)
        while len(p) < max(n, PIECE + 1):
            p = np.concatenate([p, p * np.uint64(pow(x, len(p), modulus)) % np.uint64(modulus)])
        out.append(p)
    if n <= PIECE + 1:
        _pow[field] = out[0][: PIECE + 1], out[1][: PIECE + 1]
    return out[0], out[1]


def _hash_piece(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin:end] for each word, by prefix sums of (byte + 1) * base**position in each field."""
    values, parts = data.astype(np.uint64) + np.uint64(1), []
    for field, (modulus, _) in enumerate(FIELDS):
        up, down = _powers(field, len(data) + 1)
        terms = values * up[: len(data)]
        if len(data) > 1 << 24:
            terms %= np.uint64(modulus)  # the sum of more would not fit
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=prefix[1:])
        parts.append((prefix[end] - prefix[begin]) % np.uint64(modulus) * down[begin] % np.uint64(modulus))
    return mix(parts[0] << np.uint64(31) | parts[1] ^ ((end - begin).astype(np.uint64) << np.uint64(62)))


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin:end] for each word, the words being in order."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):  # pieces end between words; a word longer than a piece is a piece of its own
        j = max(i + 1, int(np.searchsorted(end, begin[i] + PIECE, "right")))
        lo = begin[i]
        out[i:j] = _hash_piece(data[lo : end[j - 1]], begin[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def string_hashes(strings: pa.Array) -> np.ndarray:
    """The hash of each of these strings, the one that it has as a word of a text."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] else np.zeros(0, np.uint8)
    return _hashes(data, offsets[:-1], offsets[1:])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text): `offsets` are the texts' bounds in `data`."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(begin) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    out = _hashes(data, begin, end)
    return out, np.searchsorted(begin, offsets)


def windows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its first word) of every run of `size` words inside one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(BASE) + words[k : k + n]
    room = np.repeat(bounds[1:], np.diff(bounds))[:n] - np.arange(n)
    at = np.flatnonzero(room >= size)
    return mix(h[at]), at


def word_strings(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words with A-Z in small letters, words before each text): a word is a run of bytes for which `solid` holds. Bytes are copied once, without a string a word in Python."""
    data = LOWER[data]
    inside = solid[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = inside[inner]
    begin, body = np.flatnonzero(first), data[inside]
    bounds = np.append(np.cumsum(inside)[begin] - 1, len(body)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return words, np.searchsorted(begin, offsets)


def slices(column: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a string column, at most about `limit` bytes at a time. Nulls are empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    if column.null_count:  # bytes below a null do not count, so texts are laid out anew
        column = pc.fill_null(column, "")
        yield from slices(column, limit)
        return
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j

"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is `window` consecutive words of one document. Every word covered by a window whose
word sequence also starts in a document with a smaller id is removed; repeated windows that
overlap or touch merge into maximal removal intervals. Windows are judged on the input.

How it scales. Documents are dealt into chunks of about `chunk_bytes` of text. A chunk reports its distinct window hashes, each with the smallest document
id in the chunk that holds it, as sorted and packed blocks, one for each range of hashes; a window
that stands in a third of all documents is so reported once a chunk, not once a document. Each range
of hashes is then resolved on its own: a hash whose smallest document is below the chunk's own is
answered by one bit. The chunk reads its text again and turns the bits into intervals. Nothing is
capped: the number of ranges follows the size of the corpus.

Window hashes have 64 bits, made of word hashes in two prime fields (see words.py), so no texts are known that clash by construction; among n different windows about
n**2 / 2**65 pairs clash by chance, some millions of 10**13.

Defined results: a null or empty text has no words and keeps the empty string. Rows that repeat an
id are no duplicates of each other, as neither id is smaller. A null id counts as larger than every other. An empty
table gives an empty result. Only the id and text columns are read; others are ignored.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import slices, windows, word_hashes

WINDOW = 13
CHUNK_BYTES = 2 << 20
MIN_CHUNKS = 64
BUCKET_WINDOWS = 1 << 19
LAST = np.iinfo(np.int64).max


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of a 64-bit array: the planes of small differences are nearly constant and compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _block(hashes: np.ndarray, ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    low = ids.min()
    head = np.array([low], np.int64).tobytes()
    return squeeze.compress(head + _pack(np.diff(hashes, prepend=np.uint64(0))) + _pack((ids - low).astype(np.uint64)))


def _unblock(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    half = 8 + (len(raw) - 8) // 2
    low = np.frombuffer(raw[:8], np.int64)[0]
    return np.cumsum(_unpack(raw[8:half]), dtype=np.uint64), _unpack(raw[half:]).astype(np.int64) + low


def _windows_of(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Of one chunk: hashes of all windows, the row each starts in, and for each slice its first row, word bounds and windows' starts."""
    hashes, rows, parts, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
    for piece in texts.chunks:
        for i, j, data, offsets in slices(piece, 1 << 19):
            words, bounds = word_hashes(data, offsets)
            h, at = windows(words, bounds, size)
            hashes.append(h)
            rows.append(np.searchsorted(bounds, at, "right") - 1 + base)
            parts.append((base, bounds, at))
            base += j - i
    return np.concatenate(hashes), np.concatenate(rows), parts


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table["id"], LAST).to_numpy().astype(np.int64)


def _smallest(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the smallest owner of each, and the place of every window among them."""
    distinct, place = np.unique(hashes, return_inverse=True)
    low = np.full(len(distinct), LAST, np.int64)
    np.minimum.at(low, place, owner)
    return distinct, low, place


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _edges(of: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    at = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    return [(i, j) for i, j in zip(at, at[1:], strict=False) if j > i]


def _report(chunk: pa.Table, size: int, buckets: int) -> pa.Table:
    squeeze = zstandard.ZstdCompressor(level=1)
    hashes, rows, _ = _windows_of(chunk["text"], size)
    distinct, low, _ = _smallest(hashes, _ids(chunk)[rows])
    of = _bucket(distinct, buckets).astype(np.int64)
    runs = _edges(of)
    blocks = [_block(distinct[i:j], low[i:j], squeeze) for i, j in runs]
    return pa.table({"chunk": pa.array([chunk["chunk"][0].as_py()] * len(runs), pa.int64()), "bucket": pa.array([int(of[i]) for i, _ in runs], pa.int64()), "block": pa.array(blocks, pa.binary())})


def _resolve(group: pa.Table) -> pa.Table:
    """One range of hashes: for each chunk a bit for each of its hashes, set if a smaller document has it."""
    parts = [_unblock(b) for b in group["block"].to_pylist()]
    hashes, ids = np.concatenate([h for h, _ in parts]), np.concatenate([i for _, i in parts])
    _, low, place = _smallest(hashes, ids)
    hit = low[place] < ids
    keep, bits, at = [], [], 0
    for k, (h, _) in enumerate(parts):
        mine = hit[at : at + len(h)]
        at += len(h)
        if mine.any():
            keep.append(k)
            bits.append(np.packbits(mine).tobytes())
    return group.select(["chunk", "bucket"]).take(pa.array(keep, pa.int64())).append_column("bits", pa.array(bits, pa.binary()))


def _intervals(covered: np.ndarray) -> np.ndarray:
    """(begin, end) of every run of covered words."""
    step = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)


def _apply(chunk: pa.Table, answers: pa.Table, size: int, buckets: int) -> pa.Table:
    owner, texts = _ids(chunk), chunk["text"]
    hashes, rows, parts = _windows_of(texts, size)
    distinct, low, place = _smallest(hashes, owner[rows])
    flags = np.zeros(len(distinct), bool)
    told = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True))
    of = _bucket(distinct, buckets).astype(np.int64)
    for i, j in _edges(of) if told else []:
        if bits := told.get(int(of[i])):
            flags[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
    hit = flags[place] | (low[place] < owner[rows])
    out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "spans", "kept")}
    done = 0
    for base, bounds, at in parts:
        mine = at[hit[done : done + len(at)]]
        done += len(at)
        n = int(bounds[-1])
        depth = np.bincount(mine, minlength=n + 1)[: n + 1] - np.bincount(mine + size, minlength=n + 1)[: n + 1]
        gone = np.cumsum(depth[:n]) > 0
        for row, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), base):
            words = (texts[row].as_py() or "").encode().split()
            dead = gone[lo:hi]
            some = bool(dead.any())
            out["n_words"].append(hi - lo)
            out["n_removed"].append(int(dead.sum()))
            out["spans"].append(_intervals(dead).tolist() if some else [])
            out["kept"].append(b" ".join(compress(words, (~dead).tolist()) if some else words).decode())
    return pa.table({"id": chunk["id"], "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "spans": pa.array(out["spans"], pa.list_(pa.list_(pa.int64()))), "kept": pa.array(out["kept"], pa.string())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Documents without their repeated passages.

    Returns id_col, n_words, n_removed, spans (removal intervals as [first word, end) in word
    numbers, maximal and in order) and kept (the kept words joined by one space), one row per input row.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(MIN_CHUNKS, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / 6 / bucket_windows))
    # Both uses of these rows are dealt out by the same key, so Spark shuffles the texts once.
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    blocks = dealt.groupBy("chunk").applyInArrow(lambda t: _report(t, window, buckets), "chunk long, bucket long, block binary")
    bits = blocks.groupBy("bucket").applyInArrow(_resolve, "chunk long, bucket long, bits binary")
    out = dealt.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(lambda t, a: _apply(t, a, window, buckets), "id long, n_words long, n_removed long, spans array<array<long>>, kept string")
    return out.withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

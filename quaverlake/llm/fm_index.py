"""Benchmark decontamination: an FM-index per training shard, searched backwards for test phrases.

A phrase is `window` consecutive words of a benchmark item; an item of fewer words, but not none, is one phrase. Every word of a document inside any occurrence
of a phrase is hit.

How it works. A task cuts the texts that it reads into shards of at most `shard_words` words and indexes each over words, not bytes: the suffixes are sorted by
tripling ranks, the Burrows-Wheeler transform goes into a wavelet tree stored level by level (a wavelet matrix), and positions are kept of every
`RATE`-th suffix position and of all that begin a document. The index is a table, one row a shard, which can be searched again for other phrases. A search
takes all phrases of a block at once: word by word from their last, each narrows its row range by two ranks; phrases whose range is empty
fall out. Ranges that are left are located by walking back to a sampled position, and overlapping spans of a document merge.

How it scales. Texts are never shuffled: index and search are map tasks, and only ids and spans of documents meet by key. Shards have a
fixed size whatever the corpus has, and a document longer than a shard continues in the next one, overlapping by `window` - 1 words. Phrases are
dealt by hash into blocks of about `block_phrases`, which is what is collected and broadcast at a time; more of them take more passes over the index, never over the texts.

Words are compared as such, not by hashes: index and phrases share dictionaries of strings.

Defined results: null texts and items have no words; empty tables give no rows or no hits. Rows that repeat an id are rows of their own, also in the result.
An item that repeats an id counts once for it; one with a null id hits words but is no item. Columns other than ids and texts are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import Bits, packed
from .shared import cut, table
from .words import slices, word_strings

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_PHRASES = 200_000
RATE = 16
#: Occurrences that are located at once.
LOCATE = 1 << 20
#: Digits, letters and all bytes of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def suffixes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of `codes`, in which `ends` marks separators; separators sort before all else, by position, so no order looks beyond one.

    Buckets of equal first h codes are sorted by the ranks of what follows at h and 2h, and h triples; suffixes alone in their bucket are
    left alone, so text that does not repeat is done in two or three rounds."""
    n = len(codes)
    rank = np.where(ends, np.cumsum(ends) - 1, codes + int(ends.sum())).astype(np.int64)
    bits = np.int64(max(n, int(rank.max()) + 1).bit_length())
    assert 3 * bits <= 63, "shards are too large"

    def ahead(at: np.ndarray, h: int) -> np.ndarray:
        return np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)

    order, slot, h = np.arange(n), np.arange(n), 1
    while len(order):
        key = (rank[order] << (2 * bits)) | (ahead(order, h) << bits) | ahead(order, 2 * h)
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        if h == 1:
            full = order.copy()
        else:
            full[slot] = order
        head = np.maximum.accumulate(np.where(new, slot, 0))
        rank[order] = head
        alone = new & np.append(new[1:], True)
        order, slot, h = order[~alone], slot[~alone], 3 * h
    return full


class Index:
    """The FM-index of one shard. Codes are places in the alphabet, plus 1; 0 is the separator."""

    def __init__(self, n: int, counts: bytes, levels: list[bytes], marks: bytes, samples: bytes):
        self.n, self.counts = n, np.frombuffer(counts, np.int64)
        self.levels, self.marks, self.samples = [Bits.of(x) for x in levels], Bits.of(marks), np.frombuffer(samples, np.int32)
        self.zeros = [n - int(b.rank(np.array([n]))[0]) for b in self.levels]
        codes = np.arange(len(self.counts) - 1)
        # Where the rows that begin with a code stand, less what the walk through the tree starts from.
        self.base = self.counts[:-1] - self._walk(codes, np.zeros(len(codes), np.int64))

    @staticmethod
    def build(codes: np.ndarray, ends: np.ndarray, sigma: int) -> dict:
        """Parts of the index of a text that ends with a separator."""
        n = len(codes)
        order = suffixes(codes, ends)
        left = codes[order - 1]  # before the first position stands the last, a separator
        counts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma), dtype=np.int64)])
        marked = (left == 0) | (order % RATE == 0)
        levels, row = [], left.astype(np.int32)
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (row >> shift) & 1 > 0
            levels.append(packed(bit))
            row = np.concatenate([row[~bit], row[bit]])
        return {"n": n, "counts": counts.tobytes(), "levels": levels, "marks": packed(marked), "samples": order[marked].astype(np.int32).tobytes()}

    def _walk(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place of row bound i among the rows of `code`, in the last level's order."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(i)
            i = np.where((code >> (len(self.levels) - 1 - k)) & 1, zeros + ones, i - ones)
        return i

    def step(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The bound that row bound i becomes when `code` is put before what has been matched."""
        return self.base[code] + self._walk(code, i)

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one code earlier."""
        code, i = np.zeros(len(row), np.int64), row
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level.at(i), level.rank(i)
            code, i = code << 1 | bit, np.where(bit, zeros + ones, i - ones)
        return self.base[code] + i

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high): the row ranges of the phrases that occur. Phrases are rows of codes, aligned at the right; a code below 0 is of no word of the shard."""
        width = phrases.shape[1]
        used = np.arange(width)[None, :] >= width - lengths[:, None]
        alive = np.flatnonzero(((phrases > 0) | ~used).all(1))
        last = phrases[alive, width - 1]
        low, high = self.counts[last], self.counts[last + 1]
        done: list[tuple] = []
        for k in range(1, width + 1):
            over = lengths[alive] == k
            done.append((alive[over], low[over], high[over]))
            alive, low, high = alive[~over], low[~over], high[~over]
            if not len(alive):
                break
            code = phrases[alive, width - 1 - k]
            low, high = self.step(code, low), self.step(code, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the shard of each row's suffix."""
        out, steps, at, rows = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(rows):
            here = self.marks.at(rows)
            out[at[here]] = self.samples[self.marks.rank(rows[here])] + steps
            at, rows = at[~here], self.back(rows[~here])
            steps += 1
        return out


@dataclass
class Piece:
    """Words of one document inside a shard: `first` is the number of the first, `fresh` how many no earlier piece has."""

    key: int
    row: int
    first: int
    fresh: int
    words: pa.Array


def _words(column: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """(row, words) of each text; words of a text longer than `limit` bytes come in several turns, cut between words."""
    for i, j, data, offsets in slices(column, limit):
        if len(data) <= 2 * limit:
            words, bounds = word_strings(data, offsets, WORD)
            for k in range(j - i):
                yield i + k, words[bounds[k] : bounds[k + 1]]
            continue
        at = 0
        while at < len(data):
            end = min(len(data), at + limit)
            while end < len(data) and WORD[data[end] | 0x20 if 0x41 <= data[end] < 0x5B else data[end]]:
                end += 1
            yield i, word_strings(data[at:end], np.array([0, end - at]), WORD)[0]
            at = end


def _shard(number: int, pieces: list[Piece], ids: pa.Array) -> dict:
    words = pa.chunked_array([p.words for p in pieces], pa.large_string()).combine_chunks().dictionary_encode()
    sizes = np.array([len(p.words) for p in pieces])
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes, ends = np.zeros(int(sizes.sum()) + len(pieces), np.int64), np.zeros(int(sizes.sum()) + len(pieces), bool)
    ends[starts + sizes] = True
    codes[~ends] = words.indices.to_numpy() + 1
    parts = Index.build(codes, ends, len(words.dictionary) + 1)
    alphabet = " ".join(words.dictionary.to_pylist())
    docs = {"key": [p.key for p in pieces], "first": [p.first for p in pieces], "fresh": [p.fresh for p in pieces], "start": starts.tolist(), "id": ids}
    return {"shard": number, "alphabet": alphabet, "docs": docs} | parts


def _index(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 40
    shard, rows, pieces, room = 0, 0, [], shard_words
    ids: list[pa.Array] = []

    def close() -> pa.RecordBatch:
        nonlocal shard, pieces, room, ids
        row = _shard(part + shard, pieces, pa.concat_arrays(ids))
        docs = pa.StructArray.from_arrays([pa.array(row["docs"][k], pa.int64()) for k in ("key", "first", "fresh", "start")] + [row["docs"]["id"]], ["key", "first", "fresh", "start", "id"])
        docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        fields = [pa.array([row["shard"]], pa.int64()), pa.array([row["n"]], pa.int64()), pa.array([row["alphabet"]], pa.string()), pa.array([row["counts"]], pa.binary()), pa.array([row["levels"]], pa.list_(pa.binary())), pa.array([row["marks"]], pa.binary()), pa.array([row["samples"]], pa.binary()), docs]
        shard, pieces, room, ids = shard + 1, [], shard_words, []
        return pa.RecordBatch.from_arrays(fields, ["shard", "n", "alphabet", "counts", "levels", "marks", "samples", "docs"])

    for batch in batches:
        own, last, done, tail = batch.column("id"), -1, 0, None
        for row, words in _words(batch.column("text"), 4 << 20):
            if row != last:
                last, done, tail = row, 0, None
            elif tail is not None:  # the same document goes on: what came before may begin a phrase
                words = pa.concat_arrays([tail, words])
            at, known = 0, 0 if tail is None else len(tail)
            while True:
                take = min(len(words) - at, room - 1)
                pieces.append(Piece(part + rows + row, row, done - known + at, max(0, take - known if at == 0 else take - (window - 1)), words[at : at + take]))
                ids.append(own.slice(row, 1))
                room -= take + 1
                if at + take == len(words):
                    break
                yield close()
                at += take - (window - 1)
            done += len(words) - known
            tail = words[max(0, len(words) - (window - 1)) :]
            if room <= 2 * window:
                yield close()
        rows += len(batch)
    if pieces:
        yield close()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of all texts, one row a shard, for phrases of at most `window` words. Written by its user, it can be searched again and again."""
    if not 1 <= window or not 8 * window <= shard_words <= 1 << 20:
        raise ValueError("shards take at least eight windows and at most 2**20 words")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    doc = T.StructType([T.StructField(k, T.LongType()) for k in ("key", "first", "fresh", "start")] + [T.StructField("id", rows.schema["id"].dataType)])
    kinds = {"shard": T.LongType(), "n": T.LongType(), "alphabet": T.StringType(), "counts": T.BinaryType(), "levels": T.ArrayType(T.BinaryType()), "marks": T.BinaryType(), "samples": T.BinaryType(), "docs": T.ArrayType(doc)}
    return rows.mapInArrow(lambda it: _index(it, window, shard_words), T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column("item")
        for row, words in enumerate(_whole(batch.column("text"))):
            n = len(words)
            for at in range(0, max(0, n - window) + 1 if n else 0, 4096):
                begins = range(at, min(at + 4096, max(0, n - window) + 1))
                spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [min(window, n)] * len(begins)), pa.int32()), pa.concat_arrays([words[b : b + window] for b in begins]).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([items.slice(row, 1)] * len(begins)), spans], ["item", "words"])


def _whole(column: pa.Array) -> Iterator[pa.Array]:
    for i, j, data, offsets in slices(column):
        words, bounds = word_strings(data, offsets, WORD)
        for k in range(j - i):
            yield words[bounds[k] : bounds[k + 1]]


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, words): the windows of every item, its id as a string."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _windows(it, window), "item string, words array<string>")


@dataclass
class Block:
    """Distinct phrases as rows of places in `vocabulary`, aligned at the right, and the items that have them."""

    vocabulary: pa.Array
    codes: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        words = rows["words"].combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten().dictionary_encode()
        codes = np.full((len(lengths), int(lengths.max())), -1, np.int64)
        codes[np.arange(codes.shape[1])[None, :] >= codes.shape[1] - lengths[:, None]] = flat.indices.to_numpy()
        distinct, of = np.unique(codes, axis=0, return_inverse=True)
        named = rows["item"].combine_chunks()
        named = (named.chunk(0) if isinstance(named, pa.ChunkedArray) else named).dictionary_encode()
        item = pc.fill_null(named.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.argsort(of.ravel(), kind="stable")
        bounds = np.searchsorted(of.ravel()[by], np.arange(len(distinct) + 1))
        return cls(flat.dictionary, distinct, (distinct >= 0).sum(1), bounds, item[by], named.dictionary.to_pylist())


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, value) for every value of every range."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]


def merged(group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, begin, end) of the maximal spans of each group: spans that overlap or touch are one."""
    by = np.lexsort((begin, group))
    group, begin, end = group[by], begin[by], end[by]
    if not len(group):
        return group, begin, end
    # Ends grow by group, so that a running maximum never reaches into the next group.
    shift = np.cumsum(np.append(0, np.diff(group) != 0)) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, begin[1:] + shift[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return group[at], begin[at], (reach - shift)[np.append(at[1:], len(group)) - 1]


def _hits(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """(key, spans, items) of each document of a shard that a phrase of the block occurs in."""
    for batch in batches:
        for r in range(len(batch)):
            get = lambda c: batch.column(c)[r].as_py()  # noqa: E731, B023
            alphabet = pc.split_pattern(pa.array([get("alphabet")]), " ").flatten()
            place = pc.fill_null(pc.index_in(block.vocabulary, value_set=alphabet), -2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            codes = np.where(block.codes >= 0, np.append(place, 0)[block.codes], 0)
            index = Index(get("n"), get("counts"), get("levels"), get("marks"), get("samples"))
            phrase, low, high = index.find(codes, block.lengths)
            if not len(phrase):
                continue
            docs = batch.column("docs")[r].values
            column = {k: docs.field(k).to_numpy() for k in ("key", "first", "start")}
            spans, pairs = [], []
            turn = np.cumsum(high - low) // LOCATE
            for t in np.unique(turn):
                mine = turn == t
                of, rows = _ranges(low[mine], high[mine])
                at, hit = index.locate(rows), phrase[mine][of]
                doc = np.searchsorted(column["start"], at, "right") - 1
                begin = at - column["start"][doc] + column["first"][doc]
                spans.append(np.stack(merged(doc, begin, begin + block.lengths[hit])))
                pairs.append(np.unique(doc * len(block.lengths) + hit))
            doc, begin, end = merged(*np.concatenate(spans, 1))
            pair = np.unique(np.concatenate(pairs))
            of, item = _ranges(block.bounds[pair % len(block.lengths)], block.bounds[pair % len(block.lengths) + 1])
            owner, item = (pair // len(block.lengths))[of], block.items[item]
            mine = np.unique(np.stack([owner, item], 1)[item >= 0], axis=0)
            each = np.unique(doc)
            bound = lambda x: pa.array(np.append(np.searchsorted(x, each), len(x)), pa.int32())  # noqa: E731, B023
            names = pa.array([block.names[i] for i in mine[:, 1]], pa.string())
            pair_type = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["begin", "end"])
            yield pa.RecordBatch.from_arrays([pa.array(column["key"][each]), pa.ListArray.from_arrays(bound(doc), pair_type), pa.ListArray.from_arrays(bound(mine[:, 0]), names)], ["key", "spans", "items"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans of each row, and counts their words."""
    for batch in batches:
        spans = batch.column("spans")
        size = pc.list_value_length(spans).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = spans.flatten()
        row, begin, end = merged(np.repeat(np.arange(len(batch)), size), flat.field("begin").to_numpy(), flat.field("end").to_numpy())
        hit = np.bincount(row, end - begin, len(batch)).astype(np.int64)
        out = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["begin", "end"]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(hit), out, batch.column("items")], ["id", "n_words", "n_hit", "spans", "items"])


def search(index: DataFrame, wanted: DataFrame, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """(key, spans, items) of the documents in which phrases (item, words) occur; a document may have a row for each shard and each block of phrases."""
    spark, schema = index.sparkSession, "key long, spans array<struct<begin: long, end: long>>, items array<string>"
    blocks = math.ceil(wanted.count() / block_phrases)
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, blocks))))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        # About block_phrases rows of at most `window` words.
        rows = dealt.where(F.col("block") == b).select("item", "words").toArrow()
        if len(rows):
            block = spark.sparkContext.broadcast(Block.of(rows))
            out = out.unionByName(index.mapInArrow(lambda it, block=block: _hits(it, block.value), schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """(id_col, n_words, n_hit, spans, items) of every document: spans are maximal runs of hit words, as [begin, end) in word numbers and in order; items are
    the sorted ids of the items that it holds phrases of."""
    index = cut(build_index(docs, id_col, text_col, window, shard_words))
    wanted = cut(phrases(items, item_id_col, item_text_col, window))
    hits = search(index, wanted, block_phrases)
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    base = index.select(F.explode("docs").alias("d")).select("d.key", "d.id", "d.fresh", *[none(hits.schema[c]) for c in ("spans", "items")])
    rows = base.unionByName(hits, allowMissingColumns=True)
    # A group holds one document: a row for each of its pieces, and one for each of these and each block with hits.
    gather = lambda c: F.flatten(F.collect_list(c)).alias(c)
    each = rows.groupBy("key").agg(F.max("id").alias("id"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_words"), gather("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    result = T.StructType([each.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", hits.schema["spans"].dataType), T.StructField("items", hits.schema["items"].dataType)])
    return each.select("id", "n_words", "spans", "items").mapInArrow(_joined, result).withColumnRenamed("id", id_col)


def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, d.m, i, item FROM d JOIN p ON d.m = p.m AND d.phrase = p.phrase),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM (SELECT DISTINCT doc_id, m, i FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""

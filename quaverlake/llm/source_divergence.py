"""Source divergence audit: how far the term distributions of the sources of a language lie apart, by a recount with minimal perfect hashes.

First pass: exact document frequencies of all terms of each language; terms in at least `min_docs` of its documents are kept. Kept terms are dealt
into shards, each of which gets a minimal perfect hash with its terms stored in slot order (see perfect_hash.py). Shards are broadcast, at most
about `broadcast_bytes` at a time. Second pass: a task looks up its distinct terms, checks them against the stored ones and counts them for each (lang,
source) group that it meets, as pairs of slot and count that are summed now and then. If the hashes need more than one broadcast, texts are read once for each.

Shares: with V kept terms of a language and N occurrences of kept terms in a group, a term of `count` occurrences has p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)). The
distance of p and q is floor((p - q)**2 / (p + q)). Part `pair` sums it over all kept terms for every two sources of a language, part
`term` lists the ten terms that stand out most in a source against its language. All arithmetic is on integers; shares are exact below 9e15 occurrences of a language.

How it scales. Both passes reduce terms before the shuffle, a frequent word to a row a task. Slots are compared shard by shard: a task holds
`cells` numbers at a time, as a shard of a language with many sources takes fewer terms, and sources are dealt into tiles. Rows of
part `pair` grow with the square of a language's sources, as every two of them are a result.

Defined results: null texts, langs and sources are read as ''. Groups without terms are groups; where a language keeps no term all its pairs have the value 0. Rows that repeat an
id are documents of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import perfect_hash
from .perfect_hash import Shards
from .shared import cut, table, uncut
from .words import slices, string_hashes, word_strings

MIN_DOCS, TOP = 10, 10
SHARD_TERMS, BROADCAST_BYTES = 1024, 16 << 20
#: Bytes of text that a task works on at once, some 50 bytes of working memory each.
PIECE = 2 << 20
#: Counts that a task holds at once, and sources of a tile.
CELLS, TILE = 1 << 22, 256
#: Letters and all bytes of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UNIT = 1_000_000_000


def _coded(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    c = batch.column(name).dictionary_encode()
    return c.indices.to_numpy(), c.dictionary


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """(rows, row of each word, code of each word, distinct words) of about PIECE bytes of texts at a time."""
    for batch in batches:
        for i, j, data, offsets in slices(batch.column("text"), PIECE):
            words, bounds = word_strings(data, offsets, WORD)
            words = words.dictionary_encode()
            yield batch.slice(i, j - i), np.repeat(np.arange(j - i), np.diff(bounds)), words.indices.to_numpy().astype(np.int64), words.dictionary


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of a language that have a term."""
    for rows, row, code, terms in _texts(batches):
        lang, langs = _coded(rows, "lang")
        many = max(1, len(terms))
        once = np.unique(row * many + code)
        pair, n = np.unique(lang[once // many] * many + once % many, return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(pair // many)), terms.take(pa.array(pair % many)).cast(pa.string()), pa.array(n)], ["lang", "term", "n"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the shard of each term."""
    for batch in batches:
        shard = perfect_hash.shard_of(batch.column("term").cast(pa.large_string()), batch.column("shards").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(shard), batch.column("shards"), batch.column("term")], ["lang", "shard", "shards", "term"])


def _hashed(terms: pa.Table) -> pa.Table:
    """The perfect hash of one shard."""
    sizes, bits, keys = perfect_hash.build(pa.concat_arrays(terms["term"].cast(pa.large_string()).chunks))
    head = terms.select(["lang", "shard", "shards"]).slice(0, 1)
    lists = [("sizes", pa.array([sizes], pa.list_(pa.int64()))), ("bits", pa.array([bits], pa.binary())), ("keys", pa.array([keys.to_pylist()], pa.list_(pa.string())))]
    for name, column in lists:
        head = head.append_column(name, column)
    return head


class Counters:
    """Occurrences of slots in the (lang, source) groups that a task has met, as sorted keys and their counts, and their rows when they are handed on."""

    def __init__(self, shards: Shards, cells: int):
        self.shards, self.cells, self.groups, self.names = shards, cells, {}, []
        self.slots = max(1, int(shards.first[-1]))
        self.keys, self.counts, self.late, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        sizes = np.diff(shards.first)
        self.where = np.repeat(np.arange(len(sizes)), sizes)
        self.number = np.zeros(len(sizes), np.int64)  # of each shard in its language
        for places in shards.known.values():
            self.number[places[places >= 0]] = np.flatnonzero(places >= 0)

    def add(self, group: tuple[str, str], slots: np.ndarray, n: np.ndarray) -> None:
        """Each slot at most once."""
        if group not in self.groups:
            self.groups[group] = len(self.names)
            self.names.append(group)
        self.late.append((self.groups[group] * self.slots + slots, n))
        self.waiting += len(slots)

    def full(self) -> bool:
        """Whether there are more counts than cells, once those of a slot are summed."""
        if self.waiting > max(len(self.keys), self.cells >> 4):
            self.merge()
        return len(self.keys) > self.cells

    def merge(self) -> None:
        keys, n = (np.concatenate([x, *more]) for x, more in zip((self.keys, self.counts), zip(*self.late, strict=True), strict=True))
        self.late, self.waiting = [], 0
        by = np.argsort(keys, kind="stable")  # runs that are in order are merged
        keys, n = keys[by], n[by]
        edges = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts = keys[edges], np.add.reduceat(n, edges)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.late:
            self.merge()
        edges = np.searchsorted(self.keys, np.arange(len(self.names) + 1) * self.slots)
        for g, ((lang, source), i, j) in enumerate(zip(self.names, edges, edges[1:], strict=False)):
            slot = self.keys[i:j] - g * self.slots
            place = self.where[slot]
            text = lambda t, n=j - i: pa.array([t], pa.string()).take(pa.array(np.zeros(n, np.int64)))
            yield pa.RecordBatch.from_arrays([text(lang), pa.array(self.number[place]), text(source), pa.array((slot - self.shards.first[place]).astype(np.int32)), pa.array(self.counts[i:j])], ["lang", "shard", "source", "slot", "n"])
        self.groups, self.names, self.keys, self.counts = {}, [], self.keys[:0], self.counts[:0]


def _recount(batches: Iterator[pa.RecordBatch], shards: Shards, cells: int) -> Iterator[pa.RecordBatch]:
    """(lang, shard, source, slot, n): occurrences of kept terms."""
    counters = Counters(shards, cells)
    for rows, row, code, terms in _texts(batches):
        lang, langs = _coded(rows, "lang")
        source, sources = _coded(rows, "source")
        many, wide, hashes = max(1, len(terms)), len(sources), string_hashes(terms)
        # Distinct words of each group, each group's side by side; a language's words are looked up once.
        pair, n = np.unique((lang.astype(np.int64) * wide + source)[row] * many + code, return_counts=True)
        of, word = pair // many, pair % many
        edges = np.searchsorted(of, np.arange(len(langs) * wide + 1))
        for at, name in enumerate(langs.to_pylist()):
            begin, end = edges[at * wide], edges[(at + 1) * wide]
            asked = np.zeros(many, bool)
            asked[word[begin:end]] = True
            own = np.flatnonzero(asked)
            slots = np.full(many, -1, np.int64)
            slots[own] = shards.slots(name, terms.take(pa.array(own)), hashes[own])
            for g in range(at * wide, (at + 1) * wide):
                slot, count = slots[word[edges[g] : edges[g + 1]]], n[edges[g] : edges[g + 1]]
                if (slot >= 0).any():
                    counters.add((name, sources[g % wide].as_py()), slot[slot >= 0], count[slot >= 0])
        if counters.full():
            yield from counters.rows()
    yield from counters.rows()


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / (total + 2 * terms)), three digits at a time so that nothing leaves 64 bits."""
    part, whole, out = count + 2, np.asarray(total) + 2 * terms, 0
    for _ in range(3):
        more, part = np.divmod(part * 1000, whole)
        out = out * 1000 + more
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(counts: pa.Table, sides: pa.Table, top: int, cells: int) -> pa.Table:
    """One shard and one tile of sources: (source, item, value, term) with the sums over its slots of a source of the tile and every other one, and the first
    terms of each source of the tile. `sides` names all sources of the language, with their totals, and in a row without a source the terms."""
    out: dict[str, list] = {"source": [], "item": [], "value": [], "part": []}
    terms = next(t for t in sides["keys"].to_pylist() if t is not None)
    named = sides.filter(pc.is_valid(sides["source"])).sort_by("source")
    names, total, kept = named["source"].to_pylist(), named["total"].to_numpy(), named["terms"][0].as_py()
    whole, inside = named["whole"][0].as_py(), np.flatnonzero(named["inside"].to_numpy(zero_copy_only=False))
    place = {n: i for i, n in enumerate(names)}
    row = np.array([place[s] for s in counts["source"].to_pylist()], np.int64)
    slot, n = counts["slot"].to_numpy().astype(np.int64), counts["n"].to_numpy()
    sums = np.zeros((len(inside), len(names)), np.int64)
    best: list[tuple[np.ndarray, ...]] = []
    width = max(1, cells // len(names))
    for begin in range(0, len(terms), width):
        end = min(len(terms), begin + width)
        mine = (slot >= begin) & (slot < end)
        dense = np.zeros((len(names), end - begin), np.int64)
        dense[row[mine], slot[mine] - begin] = n[mine]
        p = shares(dense, total[:, None], kept)
        q = shares(dense.sum(0), whole, kept)
        for k, a in enumerate(inside):
            for b in range(0, len(names), 64):
                sums[k, b : b + 64] += distance(p[a], p[b : b + 64]).sum(1)
            at = np.flatnonzero((dense[a] > 0) & (p[a] > q))
            value = distance(p[a, at], q[at])
            if len(at) > top:  # all that are as far as the last of the first ones
                edge = np.partition(value, len(at) - top)[len(at) - top]
                at, value = at[value >= edge], value[value >= edge]
            best.append((np.full(len(at), a), at + begin, value))
    for k, a in enumerate(inside.tolist()):
        other = [b for b in range(len(names)) if b != a]
        out["source"] += [names[a]] * len(other)
        out["item"] += [names[b] for b in other]
        out["value"] += sums[k, other].tolist()
        out["part"] += ["pair"] * len(other)
    for a, at, value in best:
        out["source"] += [names[i] for i in a.tolist()]
        out["item"] += [terms[i] for i in at.tolist()]
        out["value"] += value.tolist()
        out["part"] += ["term"] * len(at)
    return pa.table({"lang": [sides["lang"][0].as_py()] * len(out["source"])} | out, pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("part", pa.string())]))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of terms in at least min_docs documents of a language; docs as (lang, source, text) without nulls."""
    seen = docs.select("lang", "text").mapInArrow(_documents, "lang string, term string, n long")
    return seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def perfect_hashes(terms: DataFrame, languages: DataFrame, shard_terms: int = SHARD_TERMS, cells: int = CELLS) -> DataFrame:
    """(lang, shard, shards, sizes, bits, keys) of kept terms; languages are (lang, sources, terms). A shard takes so few terms that all sources' counts of it stay below `cells`."""
    room = F.greatest(F.lit(1), F.least(F.lit(shard_terms), F.floor(F.lit(cells) / F.col("sources"))))
    dealt = terms.join(languages.select("lang", F.ceil(F.col("terms") / room).alias("shards")), "lang")
    dealt = dealt.select("lang", "shards", "term").mapInArrow(_dealt, "lang string, shard long, shards long, term string")
    return dealt.groupBy("lang", "shard").applyInArrow(_hashed, "lang string, shard long, shards long, sizes array<long>, bits binary, keys array<string>")


def recount(docs: DataFrame, hashes: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, cells: int = CELLS) -> DataFrame:
    """(lang, shard, source, slot, n): exact occurrences of the terms of `hashes` in each group, above 0."""
    spark, schema, out = docs.sparkSession, "lang string, shard long, source string, slot int, n long", None
    total = hashes.agg(F.sum(F.octet_length("bits") + F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + F.octet_length(k) + 8))).first()[0] or 0
    passes = max(1, math.ceil(total / broadcast_bytes))
    for b in range(passes):
        # About broadcast_bytes, as shards are dealt by hash and none is large.
        rows = hashes.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(passes)) == b).orderBy("lang", "shard").collect()
        shards = spark.sparkContext.broadcast(Shards.of([r.asDict() for r in rows]))
        counted = docs.mapInArrow(lambda it, shards=shards: _recount(it, shards.value, cells), schema)
        out = counted if out is None else out.unionByName(counted)
    return out.groupBy("lang", "shard", "source", "slot").agg(F.sum("n").alias("n"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shard_terms: int = SHARD_TERMS, broadcast_bytes: int = BROADCAST_BYTES, cells: int = CELLS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    read = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    rows = docs.select(read(lang_col, "lang"), read(source_col, "source"), read(text_col, "text"))
    groups = cut(rows.select("lang", "source").distinct())
    terms = cut(kept_terms(rows, min_docs))
    languages = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(terms.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    languages = cut(languages.withColumn("terms", F.coalesce("terms", F.lit(0))))
    hashes = cut(perfect_hashes(terms, languages, shard_terms, cells))
    counts = cut(recount(rows, hashes, broadcast_bytes, cells))
    uncut(terms)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = groups.join(totals, ["lang", "source"], "left").join(languages, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    named = named.join(counts.groupBy("lang").agg(F.sum("n").alias("whole")), "lang", "left")
    tiles = F.floor((F.col("sources") - 1) / tile) + 1
    named = cut(named.withColumns({"whole": F.coalesce("whole", F.lit(0)), "tiles": tiles, "own": F.pmod(F.xxhash64("source"), tiles)}))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")
    left = counts.join(languages.select("lang", tiles.alias("tiles")), "lang").select("lang", "shard", every, "source", "slot", "n")
    shards = hashes.select("lang", "shard")
    sides = named.join(shards, "lang").select("lang", "shard", every, "source", "total", "whole", "terms", "own")
    sides = sides.withColumn("inside", F.col("own") == F.col("tile")).drop("own").withColumn("keys", F.lit(None).cast("array<string>"))
    sides = sides.unionByName(hashes.join(languages.select("lang", tiles.alias("tiles")), "lang").select("lang", "shard", every, "keys"), allowMissingColumns=True)
    by = ["lang", "shard", "tile"]
    parts = left.groupBy(*by).cogroup(sides.groupBy(*by)).applyInArrow(lambda c, s: _compared(c, s, top, cells), "lang string, source string, item string, value long, part string")
    parts = cut(parts)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Every two sources of a language that keeps no term: as many rows as there are results.
    bare = named.where("terms = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    placed = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    first = placed(parts.where("part = 'term'"), "term").where(F.col("rank") <= top)
    return placed(pairs.unionByName(bare), "pair").unionByName(first)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, term, doc, count(*) AS n FROM (SELECT lang, source, doc, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM o GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT c.lang, c.source, c.term, c.n, CAST(1 + (1000000000::HUGEINT * CAST(c.n + 2 AS HUGEINT)) // CAST(sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * v.v AS HUGEINT) AS BIGINT) AS p FROM c JOIN v ON c.lang = v.lang),
l AS (SELECT c.lang, c.term, sum(c.n) AS n FROM c GROUP BY c.lang, c.term),
q AS (SELECT l.lang, l.term, CAST(1 + (1000000000::HUGEINT * CAST(l.n + 2 AS HUGEINT)) // CAST(sum(l.n) OVER (PARTITION BY l.lang) + 2 * v.v AS HUGEINT) AS BIGINT) AS q FROM l JOIN v ON l.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""

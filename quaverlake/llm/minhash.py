"""Circulant MinHash near-duplicate detection with exact verification.

Two random permutations of a universe of `UNIVERSE` slots make all signature coordinates (C-MinHash, Li and Li, 2021): the
first scatters the hashed shingles, the second is shifted circularly by k to give coordinate k. A shifted permutation is a slice
of one table, so all coordinates of a shingle are neighbours in memory. `BANDS` bands of `ROWS` coordinates propose
candidates; at a similarity of 0.75 a pair shares no band with a chance of (1 - 0.75**4)**32, about 5e-6. Every link is
then confirmed on the full shingle sets.

Words are runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z. A document's set holds its distinct runs of five words; with
fewer words, the whole sequence; without words or text it is empty and linked with nothing. Two
documents are linked if 100 * intersection >= 75 * union.

Sets hold 64-bit hashes of runs of words, whose words are hashed in two prime fields (see words.py); a link compares the full sets of its two
documents, so a wrong one needs equal hashes inside one pair, a chance of about n**2 / 2**64 for n shingles.

How it scales. Documents with equal sets collapse to one representative first. In each band bucket all
members are compared with its smallest member only, which connects most of a group of near copies without its pairs. Buckets whose members then
still lie in different components are finished in blocks of bounded size: those outside the largest component meet all other members, and a
pair is compared unless its components are joined by then, its sizes rule a link out, or its signatures agree in fewer coordinates than
a linked pair's do but with a chance of 1e-9. Pairs are never rows. The texts of candidates are
collected once and travel to the comparisons from there.

Defined results: a null id has no links, a null component and is kept. Rows that repeat an id are
one node with the links of all their texts. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, cut, table, uncut
from .words import LOWER, mix, slices, windows, word_hashes

SHINGLE = 5
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20
SEED = 20240229
#: Shingles of all members that one comparison group reads besides its hub.
GROUP_SHINGLES = 200_000
#: Members on either side of a block.
BLOCK = 512
NEAR, OF = 75, 100
#: Groups that a class of equal sets is dealt into.
SALTS = 64

_tables: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and row x of the second's shifts: its values at x, x + 1, ... (circularly)."""
    if (coordinates, seed) not in _tables:
        rng = np.random.default_rng(seed)
        sigma, pi = rng.permutation(UNIVERSE), rng.permutation(UNIVERSE).astype(np.uint32)
        _tables[coordinates, seed] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coordinates - 1]]), coordinates)
    return _tables[coordinates, seed]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(LOWER[data], offsets)
    hashes, at = windows(words, bounds, size)
    cuts = np.searchsorted(at, bounds)
    for lo, hi, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield np.unique(hashes[i:j])
        elif hi > lo:
            h = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for w in words[lo:hi]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + w
            yield mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    sigma, shifted = _permutations(coordinates, seed)
    at = sigma[(shingles % np.uint64(UNIVERSE)).astype(np.int64)]
    low = shifted[at[:2048]].min(axis=0)
    for i in range(2048, len(at), 2048):
        np.minimum(low, shifted[at[i : i + 2048]].min(axis=0), out=low)
    return low


def _sign(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Adds to the rows: the set's size and fingerprint, the band keys and the coordinates' low bytes."""
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    tag = mix(np.arange(bands, dtype=np.uint64) + np.uint64(seed))
    for batch in batches:
        for i, j, data, offsets in slices(batch.column("text"), 1 << 20):
            n, marks, keys, low = [], [], [], []
            for s in shingle_sets(data, offsets, size):
                n.append(len(s))
                marks.append(b"".join(int(x.sum()).to_bytes(8, "little") for x in (mix(s), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) if len(s) else None)
                if len(s):
                    coordinates = signature(s, bands * rows, seed)
                    keys.append(mix((coordinates.astype(np.uint64).reshape(bands, rows) * factors).sum(axis=1) ^ tag).view(np.int64).tolist())
                    low.append(coordinates.astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    low.append(None)
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())], [*part.schema.names, "n", "mark", "keys", "low"])


def _compare(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive by (hub, salt), the hub's own text before its members'. Gives every compared pair's set sizes."""
    group, hubs = None, []
    for batch in batches:
        hub, salt, own, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "salt", "side", "id"))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, _, data, offsets in slices(batch.column("text"), 1 << 20):
            for k, s in enumerate(shingle_sets(data, offsets, size), i):
                if (hub[k], salt[k]) != group:
                    group, hubs = (hub[k], salt[k]), []
                if own[k] == 0:
                    hubs.append(s)
                    continue
                for h in hubs:
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    for column, value in zip(out, (int(hub[k]), int(ids[k]), both, len(h) + len(s) - both), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "both", "either"])


def _link_blocks(batches: Iterator[pa.RecordBatch], size: int, near: int, of: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive by block (key, ob, ab). Links members of side 0 with those of side 1 that lie in other components and share
    no bucket before this one. Once two components are joined, their other pairs are not compared."""

    def joined(key: int, rows: list) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        if not left or not right:
            return []
        ids, places, keys, low = (np.array([r[c] for r in right]) for c in (1, 2, 3, 4))
        sizes = np.array([len(r[5]) for r in right])
        links = []
        for _, i, place, own, coordinates, s in left:
            shared = keys == own
            ok = (own[shared.argmax(axis=1)] == key) & shared.any(axis=1) & (ids != i) & (places != place)
            ok &= (np.minimum(sizes, len(s)) * of >= np.maximum(sizes, len(s)) * near)
            equal = (low == coordinates).sum(axis=1)
            at = np.flatnonzero(ok & (equal >= least))
            for k in at[np.argsort(-equal[at], kind="stable")].tolist():
                x, y = find(place), find(int(places[k]))
                if x == y:
                    continue
                both = len(np.intersect1d(right[k][5], s, assume_unique=True))
                if both * of >= (len(s) + len(right[k][5]) - both) * near:
                    root[x] = y
                    links.append((i, right[k][1]))
        return links

    held: list = []
    group = None
    for batch in batches:
        key, ob, ab, side, ids, places = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ob", "ab", "side", "rep", "component"))
        links = []
        for i, _, data, offsets in slices(batch.column("text"), 1 << 20):
            for k, s in enumerate(shingle_sets(data, offsets, size), i):
                if (key[k], ob[k], ab[k]) != group:
                    links += joined(int(group[0]), held) if group else []
                    group, held = (key[k], ob[k], ab[k]), []
                held.append((int(side[k]), int(ids[k]), int(places[k]), np.array(batch.column("keys")[k].as_py(), np.int64), np.frombuffer(batch.column("low")[k].as_py(), np.uint8), s))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])
    if group:
        links = joined(int(group[0]), held)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])


def _stars(crowd: DataFrame, held: DataFrame, size: int, near: int, of: int) -> DataFrame:
    """(a, b) of the links between each bucket's hub and its members. A hub's members are dealt into groups of bounded size."""
    may = F.least("n", "hub_n") * of >= F.greatest("n", "hub_n") * near
    pairs = crowd.where("rep <> hub").where(may).select("hub", F.col("rep").alias("id"), "n").distinct()
    loads = pairs.groupBy("hub").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).alias("salts"))
    work = pairs.join(loads, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), "id", F.lit(1).alias("side"))
    work = work.union(work.select("hub", "salt", F.col("hub").alias("id"), F.lit(0).alias("side")).distinct())
    rows = work.hint("merge").join(held.select(F.col("rep").alias("id"), "text"), "id").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")
    found = rows.mapInArrow(lambda it: _compare(it, size), "a long, b long, both long, either long")
    return found.where(F.col("both") * of >= F.col("either") * near).select("a", "b")


def _rest(crowd: DataFrame, held: DataFrame, first: DataFrame, size: int, near: int, of: int, least: int) -> DataFrame:
    """(a, b) of links that the stars left open: in buckets whose members lie in several components, those outside the
    largest are compared with all others, block by block; a block has bounded size and gives links, not pairs."""
    placed = crowd.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    largest = shares.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("parts > 1")
    blocks = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / GROUP_SHINGLES))
    rest = placed.select("key", "rep", "component").distinct().join(largest, "key").select(
        "key", "rep", "component", (F.col("component") != F.col("top.component")).alias("outer"),
        blocks(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("obs"), blocks(F.col("c"), F.col("n")).alias("abs"),
    )
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = rest.where("outer").select("key", "rep", "component", F.pmod(F.xxhash64("rep"), F.col("obs")).alias("ob"), spread(F.col("abs")).alias("ab"), F.lit(0).alias("side"))
    right = rest.select("key", "rep", "component", spread(F.col("obs")).alias("ob"), F.pmod(F.xxhash64("rep"), F.col("abs")).alias("ab"), F.lit(1).alias("side"))
    rows = left.unionByName(right).hint("merge").join(held.select("rep", "text", "keys", "low"), "rep").repartition("key", "ob", "ab").sortWithinPartitions("key", "ob", "ab")
    return rows.mapInArrow(lambda it: _link_blocks(it, size, near, of, least), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = SEED, near: int = NEAR, of: int = OF) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (smallest id reachable by links), kept (id_col = component_id)."""
    k = bands * rows
    sign = lambda df: df.mapInArrow(lambda it: _sign(it, shingle, bands, rows, seed), "id long, tag long, text string, n long, mark binary, keys array<long>, low binary")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).cast("string").alias("text"))
    signed = cut(sign(texts).drop("text", "low"))
    full = signed.where("mark is not null and id is not null").withColumn("salt", F.pmod(F.xxhash64("id", "tag"), F.lit(SALTS)))
    classes = full.groupBy("mark").agg(F.min(F.struct("id", "tag")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.collect_set("salt").alias("salts"))
    keyed = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("hub")).where("members > 1").select("key", "hub")
    crowd = cut(keyed.hint("merge").join(shared, "key").select("key", F.col("rep.id").alias("rep"), F.col("rep.tag").alias("tag"), "n", F.col("hub.rep.id").alias("hub"), F.col("hub.n").alias("hub_n")))

    # Texts of the members of shared buckets, once for a repeated row; all comparisons read these.
    wanted = crowd.select(F.col("rep").alias("id"), "tag").distinct()
    held = cut(sign(texts.hint("merge").join(wanted, ["id", "tag"]).dropDuplicates(["id", "tag"])).select(F.col("id").alias("rep"), "text", "keys", "low"))

    # An id that stands on several rows belongs to the classes of all of them.
    # Members of a large class meet their representative in SALTS groups.
    member = full.join(classes.select("mark", F.col("rep.id").alias("rep"), F.explode("salts").alias("salt")), ["mark", "salt"]).select("id", "rep")
    again = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.collect_set("rep").alias("all")).where("a < z").select("a", F.explode("all").alias("b"))
    first = components(_stars(crowd, held, shingle, near, of).union(again))
    least = int(near / of * k - 6 * (k * near / of * (1 - near / of)) ** 0.5)  # six standard deviations below what the threshold makes likely
    late = _rest(crowd, held, first, shingle, near, of, least)
    final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late))
    uncut(crowd, held, first)

    reached = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = signed.select("id", "n").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product. Vectors get one more component, so that all have the largest length and the nearest by inner product are the
nearest by angle; a query's is 0. Each tree splits a bounded sample at the median of its projections on the difference of two random points, down to
leaves of `leaf` points. Every row is then led to one leaf of each tree. A query searches all trees through one priority queue of
nodes, ordered by the sum of squares of its distances to the planes that it is on the wrong side of, until it has met `search` candidates and `probes` leaves. Leaf
by leaf the candidates are ranked by exact inner products in double precision, and the best of all leaves are merged.

Equal vectors are one point with its k + 1 smallest ids, which is all that a result can hold of them; a vector that a third of all rows share
is so a single candidate. Leaves are dealt into groups of at most about `group` points, and the queries that visit a leaf into sets of at most about `group`; every group of
points meets every set of queries in a task of its own, which gives the k + 1 best of each query, never pairs. `search` counts candidates as if the corpus had the sample's size, so the share of
the corpus that is searched stays and recall does not fall as it grows; a larger `sample` makes smaller leaves.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors of another
dimension than most have. Rows that repeat an id and vector count once; of several vectors of one id each is a candidate. Extra columns are ignored. Empty tables
and tables of one vector give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

TREES, LEAF, SAMPLE = 16, 256, 20_000
SEARCH, PROBES = 14_000, 10
GROUP = 4_096
SEED = 5


@dataclass
class Forest:
    """Nodes of all trees: `normal` and `at` of a split and its two children; a child below 0 is the leaf -1 - child."""

    roots: list[int]
    normal: np.ndarray
    at: np.ndarray
    child: np.ndarray
    leaves: int
    longest: float

    def lead(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while (go := np.flatnonzero(node >= 0)).size:
                side = np.einsum("ij,ij->i", x[go], self.normal[node[go]]) > self.at[node[go]]
                node[go] = self.child[node[go], side.astype(int)]
            out[:, t] = -1 - node
        return out

    def visit(self, q: np.ndarray, counts: np.ndarray, search: float, probes: int) -> list[int]:
        """The leaves that a query visits."""
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, met = [], 0.0
        while queue and (met < search or len(found) < probes):
            cost, node = heapq.heappop(queue)
            while node >= 0:
                gap = float(q @ self.normal[node]) - self.at[node]
                side = int(gap > 0)
                heapq.heappush(queue, (cost + gap * gap, int(self.child[node, 1 - side])))
                node = int(self.child[node, side])
            found.append(-1 - node)
            met += counts[-1 - node]
        return found


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))
    return np.hstack([x, rest[:, None]])


def grow(sample: np.ndarray, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    x = augmented(sample, longest)
    normals, ats, children, leaves = [], [], [], 0

    def split(rows: np.ndarray, depth: int) -> int:
        nonlocal leaves
        if len(rows) > leaf and depth < 40:
            for _ in range(5):
                a, b = rng.choice(rows, 2, replace=False)
                normal = x[a] - x[b]
                size = np.sqrt(normal @ normal)
                if not size > 0:
                    continue
                normal /= size
                p = x[rows] @ normal
                at = float(np.median(p))
                right = p > at
                if 0 < right.sum() < len(rows):
                    node = len(normals)
                    normals.append(normal)
                    ats.append(at)
                    children.append([0, 0])
                    children[node] = [split(rows[~right], depth + 1), split(rows[right], depth + 1)]
                    return node
        leaves += 1
        return -leaves  # leaf number leaves - 1

    roots = [split(np.arange(len(x)), 0) for _ in range(trees)]
    width = x.shape[1]
    return Forest(roots, np.array(normals).reshape(-1, width), np.array(ats), np.array(children, np.int64).reshape(-1, 2), leaves, longest)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _dealt(rep: np.ndarray, into: np.ndarray) -> np.ndarray:
    return (rep * np.int64(0x9E3779B1) >> 7) % into


def _spread(into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for each number from 0 up to what `into` has for the row."""
    row = np.repeat(np.arange(len(into)), into)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(into) - into, into)


def _index(batches: Iterator[pa.RecordBatch], forest: Forest, groups: np.ndarray | None, sets: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(leaf, part, set, rep, v) for each point, tree and set of queries. Without groups only the leaves, for counting."""
    for batch in batches:
        for i in range(0, len(batch), 2048):
            piece = batch.slice(i, 2048)
            leaf = forest.lead(augmented(_matrix(piece.column("v")), forest.longest)).T.ravel()
            if groups is None:
                yield pa.RecordBatch.from_arrays([pa.array(leaf)], ["leaf"])
                continue
            row = np.tile(np.arange(len(piece)), len(forest.roots))
            at, number = _spread(sets[leaf])
            leaf, row = leaf[at], row[at]
            rep = piece.column("rep").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(_dealt(rep, groups[leaf])), pa.array(number), pa.array(rep), piece.column("v").take(pa.array(row))], ["leaf", "part", "set", "rep", "v"])


def _visits(batches: Iterator[pa.RecordBatch], forest: Forest, counts: np.ndarray, groups: np.ndarray, sets: np.ndarray | None, search: float, probes: int) -> Iterator[pa.RecordBatch]:
    """(leaf, part, set, rep, v) for each query and group of points that it visits. Without sets only the leaves, for counting."""
    for batch in batches:
        for i in range(0, len(batch), 512):
            piece = batch.slice(i, 512)
            x = _matrix(piece.column("v"))
            found = [forest.visit(q, counts, search, probes) for q in np.hstack([x, np.zeros((len(x), 1))])]
            leaf, row = np.array([n for f in found for n in f], np.int64), np.repeat(np.arange(len(found)), [len(f) for f in found])
            if sets is None:
                yield pa.RecordBatch.from_arrays([pa.array(leaf)], ["leaf"])
                continue
            at, part = _spread(groups[leaf])
            leaf, row = leaf[at], row[at]
            rep = piece.column("rep").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part), pa.array(_dealt(rep, sets[leaf])), pa.array(rep), piece.column("v").take(pa.array(row))], ["leaf", "part", "set", "rep", "v"])


def _best(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    if len(points) and len(queries):
        p, ids = _matrix(points["v"].combine_chunks()), points["rep"].to_numpy()
        names, q = queries["rep"].to_numpy(), _matrix(queries["v"].combine_chunks())
        for i in range(0, len(q), 256):
            rough = q[i : i + 256] @ p.T
            top = np.argpartition(-rough, k, axis=1)[:, : k + 1] if rough.shape[1] > k + 1 else np.tile(np.arange(rough.shape[1]), (len(rough), 1))
            # Ties at the edge are kept: every point as near as the last of the best.
            edge = np.take_along_axis(rough, top, 1).min(axis=1)
            row, col = np.nonzero(rough >= (edge - 1e-12 * (1 + abs(edge)))[:, None])
            out[0].append(names[i + row])
            out[1].append(ids[col])
            out[2].append((q[i + row] * p[col]).sum(axis=1))
    flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
    return pa.table({"query": pa.array(flat[0].astype(np.int64)), "rep": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, search: int = SEARCH, probes: int = PROBES, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query(id column) holds, itself excluded."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col).cast("array<double>")
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    common = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    valid = valid.where(F.size("v") == (common.n if common else 0)).distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = valid.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = cut(members.select(F.col("ids")[0].alias("rep"), "ids", "v"))
    # A vector of its own may share its smallest id with another vector of that id.
    points = cut(points.withColumn("rep", F.when(F.count("*").over(Window.partitionBy("rep")) > 1, F.xxhash64("v")).otherwise(F.col("rep"))))
    total, longest = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    chosen = points.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    if not chosen:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = grow(np.array([r.v for r in chosen]), longest or 0.0, trees, leaf, seed)
    rows = points.select("rep", "v")

    def counted(leaves: DataFrame) -> np.ndarray:
        """How often each leaf occurs; there are at most trees * sample leaves."""
        out = np.zeros(forest.leaves, np.int64)
        for r in leaves.groupBy("leaf").count().collect():
            out[r.leaf] = r["count"]
        return out

    counts = counted(rows.mapInArrow(lambda it: _index(it, forest, None), "leaf long"))
    groups = np.maximum(1, -(-counts // group))
    scaled = search * max(1.0, (total or 0) / sample)
    schema = "leaf long, part long, set long, rep long, v array<double>"
    asked = cut(valid.where(is_query(F.col("id"))).join(points.select("v", "rep"), "v").select("id", "rep", "v"))
    queries = asked.select("rep", "v").distinct()
    sets = np.maximum(1, -(-counted(queries.mapInArrow(lambda it: _visits(it, forest, counts, groups, None, scaled, probes), "leaf long")) // group))
    index = rows.mapInArrow(lambda it: _index(it, forest, groups, sets), schema)
    visits = queries.mapInArrow(lambda it: _visits(it, forest, counts, groups, sets, scaled, probes), schema)
    by = ["leaf", "part", "set"]
    hits = index.groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(lambda p, q: _best(p, q, k), "query long, rep long, score double")
    hits = hits.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = hits.join(points.select("rep", "ids"), "rep").select("query", "score", F.col("ids"), F.col("ids")[0].alias("low"), "rep")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "low", "rep"))
    best = best.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    each = asked.select("id", F.col("rep").alias("query")).join(best, "query").select(F.col("id").alias("query_id"), F.explode("found").alias("f"))
    each = each.select("query_id", "f.score", F.explode("f.ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)

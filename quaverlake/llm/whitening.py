"""Embedding whitening by polarisation: covariances from squares alone.

Every entry c becomes the integer floor(scale * c), and the fit list is each distinct integer vector once. One pass over it sums the dimensions, a second
one aggregates exact squares of centred values, for every dimension and for the sum of every two dimensions. As
var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of these variances are the covariances; the matrix goes to `eigh`.

Exactness. Values are centred at the integer next to the mean, and the squares of what remains of the mean are taken off the sums, so
n**2 times a variance is an integer and every covariance is one correctly rounded division. Tasks use 64-bit integers where a bound shows that they suffice and
Python's own beyond; partial sums travel in two parts, so no sum overflows.

How it scales. Tasks reduce their rows to d * (d + 1) / 2 numbers before the shuffle; only those, a size of the dimension d and not of the rows,
and the d sums reach the driver, which eigh needs whole. Vectors that many rows share are one vector of the fit list after partial aggregation.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part, nor do vectors of another dimension than most
have (of equally frequent ones the smaller counts). Rows that repeat, and rows with a null id, give results of their own. Integers beyond 64
bits are the nearest of 64 bits. A deviation beyond a long is null. A component whose variance is zero, to double precision, has null as whitened value, and a matrix of
zeros null as explained. identity_error is null where no component has variance. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, table, uncut

SCALE, COMPONENTS = 256, 4
#: Rows that a task works on at once.
ROWS = 1024
LOW = 62


@dataclass
class Whitening:
    """n vectors; `centre` + `rest` / n is the mean of each dimension; `axes` are the columns that whiten, null where there is no variance."""

    n: int
    centre: list[int]
    rest: list[int]
    covariance: np.ndarray
    axes: list[np.ndarray | None]
    explained: list[float | None]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            piece = batch.slice(i, ROWS)
            yield piece, piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1)


def _centred(x: np.ndarray, centre: list[int], room: int) -> np.ndarray:
    """x - centre, as Python's integers unless `room` values of (2 * (x - centre))**2 can be added in 64 bits."""
    most = max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, centre))
    wide = (2 * most) ** 2 * room >= 1 << 62
    return (x.astype(object) if wide else x) - np.array(centre, object if wide else np.int64)


def _parts(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Sums as rows (i, j, high, low)."""
    keys = list(sums)
    high = [Decimal(sums[k] >> LOW) for k in keys]
    low = [sums[k] & ((1 << LOW) - 1) for k in keys]
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.int64())], ["i", "j", "high", "low"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of vectors, at (-1, -1), and the sum of each dimension i, at (i, -1)."""
    n, total = 0, None
    for piece, x in _blocks(batches):
        y = _centred(x, [0] * x.shape[1], len(x)).sum(0).astype(object)
        n, total = n + len(piece), y if total is None else total + y
    if n:
        yield _parts({(-1, -1): n} | {(i, -1): int(s) for i, s in enumerate(total)})


def _squares(batches: Iterator[pa.RecordBatch], centre: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums of squares of each centred dimension, at (i, i), and of the sum of every two, at (i, j)."""
    total = None
    for _, x in _blocks(batches):
        y = _centred(x, centre, len(x))
        rows = []
        for i in range(y.shape[1]):
            pair = y[:, i:] + y[:, i : i + 1]
            pair[:, 0] = y[:, i]
            rows.append((pair * pair).sum(0).astype(object))
        total = rows if total is None else [a + b for a, b in zip(total, rows, strict=True)]
    if total:
        yield _parts({(i, i + k): int(s) for i, row in enumerate(total) for k, s in enumerate(row)})


def _sums(fit_list: DataFrame, task) -> dict[tuple[int, int], int]:
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit_list.mapInArrow(task, "i int, j int, high decimal(38,0), low long").groupBy("i", "j").agg(wide("high"), wide("low"))
    return {(r.i, r.j): (int(r.high) << LOW) + int(r.low) for r in rows.toLocalIterator()}


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows that take part, with x the vector as integers."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("size(v) > 0").where(F.forall("v", fine))
    x = rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return x.where(F.size("x") == (common.d if common else 0))


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct vectors x; nothing where it is empty."""
    sums = _sums(fit_list, _totals)
    if not sums:
        return None
    n, d = sums[-1, -1], len(sums) - 1
    centre = [(2 * sums[i, -1] + n) // (2 * n) for i in range(d)]
    rest = [sums[i, -1] - n * centre[i] for i in range(d)]
    squares = _sums(fit_list, lambda it: _squares(it, centre))
    # n**2 times the variance of each dimension and of each sum of two.
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(d)]
    cov = np.empty((d, d))
    for (i, j), q in squares.items():
        both = n * q - (rest[i] + rest[j]) ** 2
        cov[i, j] = cov[j, i] = own[i] / n**2 if i == j else (both - own[i] - own[j]) // 2 / n**2
    values, vectors = np.linalg.eigh(cov)
    trace, axes, explained = float(np.trace(cov)), [], []
    for k in range(d - 1, max(-1, d - 1 - components), -1):
        e, u = float(values[k]), vectors[:, k]
        u = u * (1 if u[np.argmax(np.abs(u))] > 0 else -1)
        axes.append(u / np.sqrt(e) if e > trace * d * np.finfo(float).eps else None)
        explained.append(max(e, 0.0) / trace if trace > 0 else None)
    return Whitening(n, centre, rest, cov, axes, explained)


def _project(batches: Iterator[pa.RecordBatch], w: Whitening) -> Iterator[pa.RecordBatch]:
    """(id, deviation, w): the exact squared distance from the mean, times n**2, and the whitened values. Sums go row by row, so they do not depend on batches."""
    n, rest = w.n, np.array(w.rest, object)
    off = np.array([r / n for r in w.rest])
    far, most = sum(r * r for r in w.rest), max(map(abs, w.rest), default=0)
    for piece, x in _blocks(batches):
        y = _centred(x, w.centre, x.shape[1])
        z = y.astype(np.float64) - off
        high = int(np.abs(y).max()) * max(most, 1) * x.shape[1] < 1 << 62
        along = (y * rest.astype(np.int64)).sum(1) if high and y.dtype != object else (y.astype(object) * rest).sum(1)
        deviation = [n * n * int(q) - 2 * n * int(a) + far for q, a in zip((y * y).sum(1), along, strict=True)]
        white = [None if a is None else (z * a).sum(1) for a in w.axes]
        columns = np.stack([np.full(len(x), np.nan) if c is None else c for c in white], 1)
        flat = pa.array(columns.ravel(), mask=np.tile([c is None for c in white], len(x)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(white)), flat)
        yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()), lists], ["id", "deviation", "w"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each of the first components."""
    rows = integers(vectors, id_col, vector_col, scale)
    fit_list = cut(rows.select("x").distinct())
    w = fit(fit_list, components)
    result = T.StructType([rows.schema["id"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    if w is None:
        empty = rows.sparkSession.createDataFrame([], result)
        w = Whitening(0, [], [], np.zeros((0, 0)), [], [])
    out = rows.mapInArrow(lambda it: _project(it, w), result) if w.n else empty
    alive = [k for k, a in enumerate(w.axes) if a is not None]
    error = None
    if alive:
        seen = fit_list.select(F.lit(0).alias("id"), "x").mapInArrow(lambda it: _project(it, w), "id int, deviation long, w array<double>")
        pairs = [(a, b) for a in alive for b in alive if a <= b]
        got = seen.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]) for a, b in pairs]).first()
        error = max(abs(v - (a == b)) for (a, b), v in zip(pairs, got, strict=True))
    uncut(fit_list)
    each = out.select(F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("k", "whitened"))
    explained = F.array(*[F.lit(e).cast("double") for e in w.explained]) if w.explained else F.array().cast("array<double>")
    return each.select(id_col, (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))

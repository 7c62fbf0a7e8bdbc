"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is a linear function of text features. Preference pairs join a document of label 1 with one of label 0; the
weights minimise the logistic loss on the pairs' feature differences, with a ridge. The threshold is the quantile of
the training scores at the share of label 0. Scores are then shifted so that the threshold is 0.5.

The fit reads a bounded sample of labelled rows (`sample`, in the order of a hash of the id) whose features, a few dozen numbers each, go
to the driver. Scoring is one pass over whole texts without a shuffle. Labels are taken only from rows whose crc32 of the id as text,
modulo 3, is not 1. Features come from the text alone.

Defined results: a null or empty text has all features 0 and gets the score that follows. A null id is not held out and never trains. Several labels
of one id all count in training; of rows that repeat an id the smallest text does. Without labels of both kinds every score is 0.5. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import slices, word_hashes

SAMPLE = 20_000
PAIRS = 60_000
RIDGE = 3e-3

PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
#: Class of each byte: control, white space but newline, newline, digit, capital, small letter, byte of a longer character, each punctuation mark.
CLASSES = 7 + len(PUNCTUATION)
CLASS = np.zeros(256, np.int64)
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 1
CLASS[0x0A] = 2
CLASS[0x30:0x3A] = 3
CLASS[0x41:0x5B] = 4
CLASS[0x61:0x7B] = 5
CLASS[0x80:] = 6
CLASS[PUNCTUATION] = np.arange(7, CLASSES)
#: Besides the roots of the classes' shares: log of the size, letters a word, marks after a letter, marks after a mark, capitals after a capital, marks between spaces, lines per word.
#: Words equal to the word before, and to the one before that.
FEATURES = CLASSES + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    kind = CLASS[data]
    count = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    space, mark, capital = (kind == 1) | (kind == 2), kind >= 7, kind == 4
    letter = capital | (kind == 5) | (kind == 6)
    inside = np.ones(len(data), bool)
    inside[offsets[:-1][offsets[:-1] < len(data)]] = False
    before = lambda x: np.concatenate([[False], x[:-1]]) & inside
    tally = lambda x: np.bincount(row[x], minlength=n).astype(float)
    alone = mark.copy()
    alone[1:] &= space[:-1]
    alone[:-1] &= space[1:]
    words = tally(~space & ~before(~space)) + 1
    hashes, bounds = word_hashes(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    again = [np.bincount(owner[k:][(hashes[k:] == hashes[: len(hashes) - k]) & (owner[k:] == owner[: len(owner) - k])], minlength=n) / words if len(hashes) > k else np.zeros(n) for k in (1, 2)]
    out = np.empty((n, FEATURES))
    out[:, :CLASSES] = np.sqrt(count / np.maximum(sizes, 1)[:, None])
    extra = [np.log1p(sizes) / 10, tally(letter) / words / 10, tally(mark & before(letter)) / words, tally(mark & before(mark)) / words, tally(capital & before(capital)) / words, tally(alone) / words, count[:, 2] / words, *again]
    out[:, CLASSES:] = np.stack(extra, 1)
    return out


@dataclass
class Model:
    weights: np.ndarray
    threshold: float


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 1) -> Model:
    """Newton steps on the loss of `pairs` preference pairs drawn with every document of the rarer label equally often."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model(np.zeros(x.shape[1] if x.ndim == 2 else FEATURES), 0.0)
    rng = np.random.default_rng(seed)
    less, more = min(len(good), len(bad)), max(len(good), len(bad))
    n = max(pairs, more) if more < pairs else pairs
    pick = lambda k: np.concatenate([rng.permutation(k) for _ in range(-(-n // k))])[:n]
    d = good[pick(len(good))] - bad[pick(len(bad))]
    scale = np.sqrt((d**2).mean(axis=0)) + 1e-9
    d = d / scale
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = _logistic(d @ w)
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w)), d.T @ (1 - p) / n - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    s = np.sort(x @ w)
    k = len(bad)
    return Model(w, float((s[k - 1] + s[k]) / 2))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column("text"), 1 << 20):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    # At most `sample` pairs of numbers.
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select("id").distinct()), "id")
    texts = own.groupBy("id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.select("y", "text").mapInArrow(_feature_rows, "y int, x array<double>").collect()
    return fit_pairs(np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.y for r in rows], int))


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model, only: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column("text"), 1 << 20):
            score = _logistic(features(data, offsets) @ model.weights - model.threshold)
            part = batch.slice(i, j - i)
            if only:
                yield part.filter(pa.array(score >= 0.5))
            else:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with `score`, 0 to 1; a column of that name is replaced."""
    docs = docs.drop("score")
    return docs.mapInArrow(lambda it: _score_rows(it, model, False), _schema(docs) + ", score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is at least 0.5."""
    return docs.mapInArrow(lambda it: _score_rows(it, model, True), _schema(docs))


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

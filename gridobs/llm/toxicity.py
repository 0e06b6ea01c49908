"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that occur in it at least once, over the whole text, in lower case and with white space
as one space. Naive Bayes log-count ratios from the labelled rows scale them, and a logistic regression is fitted on the scaled features.
The fit uses a bounded sample of the labelled rows (``MAX_ROWS``: half toxic if there are as many) and keeps the ``MAX_FEATURES``
n-grams that tell the classes apart best by chi-square; every row is then scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

ORDERS, BITS, MAX_ROWS, MAX_FEATURES = (3, 4, 5, 6, 7), 20, 10_000, 8192
#: Score from which a text is rejected.
REJECT = 0.7
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, max(ORDERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all character n-grams, with repeats; empty for a null, empty or very short text."""
    codes = np.frombuffer(re.sub(r"\s+", " ", f" {text or ''} ".lower()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = []
    total = codes * _MULTIPLIERS[0]
    for n in range(2, max(ORDERS) + 1):
        total = total[:-1] + codes[n - 1 :] * _MULTIPLIERS[n - 1]
        if n in ORDERS:
            mixed = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """Sorted buckets, the weight of each if present (log-count ratio times fitted weight), and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, dtype=np.int16)
        out[self.buckets] = np.arange(len(self.buckets))
        return out


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled binary features, both classes weighted alike, by gradient steps of Adam."""
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    col = np.concatenate(rows)
    x = ratio.astype(np.float32)[col]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, bias = np.zeros(len(ratio)), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w.astype(np.float32)[col] * x, len(rows)) + bias, -30, 30)))
        g = (p - y) * share
        grad = np.append(np.bincount(col, g.astype(np.float32)[at] * x, len(ratio)) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def train(df: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on rows of ``labels`` (doc_id, toxic) where ``learn_from`` holds; of repeated labels of a document the highest counts.

    Null labels and ids are ignored. Without labelled documents of both classes the model gives every text the label of the one there is (0 without any).
    """
    known = labels.where(learn_from & F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max("toxic") == 1).cast("int").alias("y"))
    draw = [F.xxhash64("_id"), F.col("_id")]
    some = known.where("y = 1").orderBy(*draw).limit(max_rows // 2).unionByName(known.where("y = 0").orderBy(*draw).limit(max_rows // 2))
    picked = [(r["_id"], r.y) for r in some.collect()]
    n1, n0 = sum(y for _, y in picked), sum(1 - y for _, y in picked)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if n1 else -30.0)
    some = df.sparkSession.createDataFrame(picked, "_id long, y int")
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                total[y, np.unique(ngram_buckets(text.as_py()))] += 1
        some = np.flatnonzero(total.any(axis=0))
        for i in range(0, len(some), 50_000):
            part = some[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], ["bucket", "clean", "toxic"])

    counts = rows.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = F.col("toxic") / F.lit(n1), F.col("clean") / F.lit(n0)
    both = (F.col("toxic") + F.col("clean")) / F.lit(n1 + n0)
    chi = (p - q) * (p - q) / (both * (F.lit(1.0) - both) + F.lit(1e-9))
    best = counts.withColumn("chi", chi).orderBy(F.desc("chi"), "bucket").limit(max_features).orderBy("bucket").collect()
    buckets = np.array([r.bucket for r in best], dtype=np.int64)
    a, b = (np.array([r[c] for r in best], dtype=float) for c in ("toxic", "clean"))
    ratio = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
    table = Model(buckets, ratio, 0.0).table()

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_present(t.as_py(), table).astype("<i2").tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], ["features", "y"])

    sample = rows.mapInArrow(featurize, "features binary, y int").orderBy("y", "features").collect()  # at most max_rows rows of 2 * max_features bytes
    if len({r.y for r in sample}) < 2:  # labelled rows that are no documents
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if sample and sample[0].y else -30.0)
    w, bias = _fit([np.frombuffer(r.features, dtype="<i2") for r in sample], np.array([r.y for r in sample]), ratio)
    return Model(buckets, w * ratio, bias)


def _present(text: str | None, table: np.ndarray) -> np.ndarray:
    """Which of the model's features occur in the whole text."""
    found = table[ngram_buckets(text)]
    return np.unique(found[found >= 0]).astype(np.int32)


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns and rows of ``df`` and ``out``, the probability that the text is toxic.

    A null or empty text has no features and gets the score of the bias alone. A column named like ``out`` is replaced.
    """
    df = df.drop(out)
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast((model.table(), model.weights, model.bias))  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights, bias = shared.value
        for b in batches:
            z = np.array([bias + weights[_present(t.as_py(), table)].sum() for t in b.column(at)], dtype=float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned from; the rest (a third, by checksum of the id) is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1

"""Hard-negative mining with exact integer scores.

Tiles of anchors meet tiles of candidates by a shuffle join. The scores of a tile are an integer matrix product by Strassen's recursion: odd sides are
padded with a row or column of zeros, the seven half-sized products are joined by integer additions, so every score is exact. Two rounds: each anchor meets the
tiles of its own label and keeps a heap of its best positives; then it meets all tiles and keeps, for each positive, a heap of the best other-label rows inside that
positive's score window. A heap is the first few rows in the order (score falling, vec_id rising); heaps of two tiles merge to the first few of both, which
Spark does before and after its shuffle (rank limit), so no task sees more of an anchor than a few rows a tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridobs.llm._shared import materialize

LEAF, TILE, ANCHOR_TILE = 32, 4096, 512


@dataclass(frozen=True)
class Mining:
    """Each anchor's first ``positives`` rows of its label; for each of them the first ``negatives`` rows of other labels with a score from ``low`` to ``high`` percent of the positive's."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices; sides of at most ``leaf`` are multiplied plainly."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), dtype=np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:m, :n], out[m:, n:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    out[m:, :n] = p
    out[m:, n:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:m, n:] = p
    out[m:, n:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:m, :n] += p
    out[m:, :n] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:m, :n] -= p
    out[:m, n:] += p
    out[m:, n:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:m, :n] += strassen(a12 - a22, b21 + b22, leaf)
    return out


def quantised(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, vec``: one row per vec_id that takes part; each component x is ``floor(scale * x)``, a long.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part; nor do vectors of another length than the most common (ties: the
    longer), nor those with a component so large that a hundred times a score could leave the range of a long (for 64 components beyond 3.7e7 after scaling).
    Of repeated rows of a vec_id the smallest (label, vector) counts. Other columns are ignored.
    """
    x = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda v: v * float(scale)).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0))
    largest = F.floor(F.sqrt(F.lit(2.0**63) / (F.size("vec") * 100)))
    rows = rows.where(~F.exists("vec", lambda v: v.isNull() | F.isnan(v))).where(F.array_max(F.transform("vec", F.abs)) < largest)
    top = rows.groupBy(F.size("vec").alias("_n")).count().orderBy(F.desc("count"), F.desc("_n")).limit(1).select("_n")
    rows = rows.join(F.broadcast(top), F.size("vec") == F.col("_n"), "left_semi")  # one row
    whole = rows.select("vec_id", F.struct("label", F.transform("vec", lambda v: F.floor(v)).alias("vec")).alias("_row"))
    return whole.groupBy("vec_id").agg(F.min("_row").alias("_row")).select("vec_id", "_row.label", "_row.vec")


def _ints(rows: pa.Array, field: str) -> np.ndarray:
    return rows.field(field).to_numpy(zero_copy_only=False)


def _matrix(rows: pa.Array) -> np.ndarray:
    lists = rows.field("vec")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the heap: the ``k`` highest scores, highest first, ties by smaller id."""
    at = np.arange(len(score)) if len(score) <= 4 * k else np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def positive_heaps(anchor_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, rule: Mining) -> list[np.ndarray]:
    """Columns anchor, candidate, score: the heaps of a tile whose rows all have the anchors' label."""
    out: list[list[np.ndarray]] = [[], [], []]
    for anchor, score in zip(anchor_ids, scores):
        other = np.flatnonzero(ids != anchor)
        best = other[first(score[other], ids[other], rule.positives)]
        for column, values in zip(out, (np.full(len(best), anchor), ids[best], score[best])):
            column.append(values)
    return [np.concatenate(c) for c in out]


def window_heaps(anchors: list[tuple[int, int, np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, rule: Mining) -> list[np.ndarray]:
    """Columns anchor, positive, candidate, positive's score, score; ``anchors`` are (id, label, positives' ids, their scores)."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for (anchor, label, good, good_score), score in zip(anchors, scores):
        other = np.flatnonzero((100 * score >= rule.low * good_score.min()) & (100 * score <= rule.high * good_score.max()) & (labels != label))
        for g, s in zip(good, good_score):
            near = other[(100 * score[other] >= rule.low * s) & (100 * score[other] <= rule.high * s)]
            best = near[first(score[near], ids[near], rule.negatives)]
            for column, values in zip(out, (np.full(len(best), anchor), np.full(len(best), g), ids[best], np.full(len(best), s), score[best])):
                column.append(values)
    return [np.concatenate(c) for c in out]


def _tiles(rows: DataFrame, keys: list[str], columns: list[str], out: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(out))


def _heap(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """Heaps of all tiles merged: the first ``k`` of each group, numbered from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def _bucket(n: Column | int, *seed: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id", *seed), F.lit(n) if isinstance(n, int) else n)


def _meet(asked: DataFrame, tiles: DataFrame, keys: list[str], score, schema: str) -> DataFrame:
    """``score(anchors, candidates)`` for every pair of tiles with equal keys; a tile is an array of rows and of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = score(*(batch.column(c).slice(i, 1).flatten() for c in range(2)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return asked.join(tiles.hint("shuffle_hash"), keys).select("asked", "here").mapInArrow(run, schema)


def positives(rows: DataFrame, is_anchor: Column, rule: Mining, tile: int, anchor_tile: int) -> DataFrame:
    """``anchor_id, rank, positive_id, positive_score``; ``rows`` is a result of ``quantised``, read several times."""
    sizes = rows.groupBy("label").agg(
        F.ceil(F.count("*") / F.lit(tile)).alias("_tiles"), F.ceil(F.count_if(is_anchor) / F.lit(anchor_tile)).alias("_asked")
    ).where("_asked > 0")
    sized = rows.join(sizes, "label")  # a label of many rows is dealt over as many tiles as it fills
    tiles = _tiles(sized.withColumn("_b", _bucket(F.col("_tiles"))), ["label", "_b"], ["vec_id", "vec"], "here")
    asked = sized.where(is_anchor).withColumn("_q", _bucket(F.col("_asked"), F.lit(1)))
    asked = asked.groupBy("label", "_q").agg(F.first("_tiles").alias("_tiles"), F.collect_list(F.struct("vec_id", "vec")).alias("asked"))
    asked = asked.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))

    def score(anchors: pa.Array, here: pa.Array) -> list[np.ndarray]:
        return positive_heaps(_ints(anchors, "vec_id"), _ints(here, "vec_id"), strassen(_matrix(anchors), _matrix(here).T), rule)

    heaps = _meet(asked, tiles, ["label", "_b"], score, "anchor_id long, positive_id long, positive_score long")
    return _heap(heaps, ["anchor_id"], "positive_score", "positive_id", rule.positives)


def mine(rows: DataFrame, is_anchor: Column, rule: Mining = Mining(), tile: int = TILE, anchor_tile: int = ANCHOR_TILE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``is_anchor`` holds.

    ``rows`` is a result of ``quantised``. An anchor alone in its label has no positive, a positive without a row in its window (always so below a score of 0) no
    negative: neither gives a row. No rows, or no anchors: no rows. Ties by smaller vec_id throughout.
    """
    rows = materialize(rows)
    best = materialize(positives(rows, is_anchor, rule, tile, anchor_tile))
    good = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("good"))
    anchors = rows.where(is_anchor).join(good, "vec_id")
    n_tiles, n_asked = (max(1, -(-n // size)) for n, size in ((rows.count(), tile), (anchors.count(), anchor_tile)))
    tiles = _tiles(rows.withColumn("_b", _bucket(n_tiles)), ["_b"], ["vec_id", "label", "vec"], "here")
    asked = _tiles(anchors.withColumn("_q", _bucket(n_asked, F.lit(1))), ["_q"], ["vec_id", "label", "vec", "good"], "asked")
    asked = asked.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))))

    def score(who: pa.Array, here: pa.Array) -> list[np.ndarray]:
        lists = who.field("good")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        flat = lists.flatten()
        asked = zip(_ints(who, "vec_id"), _ints(who, "label"), np.split(_ints(flat, "positive_id"), ends), np.split(_ints(flat, "positive_score"), ends))
        return window_heaps(list(asked), _ints(here, "vec_id"), _ints(here, "label"), strassen(_matrix(who), _matrix(here).T), rule)

    found = _meet(asked, tiles, ["_b"], score, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    found = _heap(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", rule.negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

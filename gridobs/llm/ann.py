"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of nearness: few of many, so that most inverted files don't concern it. Per block of vectors,
inverted files list for every pivot the vectors that have it among their nearest, with its position there. A query reads the files of its own
pivots only, ranks what it finds there by Spearman's footrule on the positions, and reranks the best by exact cosine.
Blocks of vectors meet blocks of queries by a shuffle join, so neither side has to fit in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridobs.llm._shared import materialize

N_PIVOTS, NEAREST, BLOCK, QUERY_BLOCK, RERANK, AT_LEAST = 2048, 24, 8192, 1024, 0.9, 64


def _scaled(m: np.ndarray) -> np.ndarray:
    """Every row times the power of two that brings its largest component to between 0.5 and 1: no cosine changes, and no square leaves the range of doubles."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(df: DataFrame) -> DataFrame:
    """``vec_id, vec`` (array of double): one row per vec_id; only finite non-zero vectors of the most common length.

    Vectors that are null, empty, zero, or hold null, NaN or infinite components take no part, and neither do
    those of another length (ties: the longer length counts). Of repeated rows of a vec_id, the smallest vector counts.
    """
    vec = F.col("embedding").cast("array<double>")
    rows = df.where(F.col("vec_id").isNotNull()).select("vec_id", vec.alias("vec"))
    rows = rows.where(
        F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    top = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    rows = rows.join(F.broadcast(top.select("n")), F.size("vec") == F.col("n"), "left_semi")
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.ListArray, width: int, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(-1, width)


def permutations(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """``vec_id, vec, perm``: the vector, scaled by a power of two, and the indexes of the nearest pivots, nearest first."""
    pivots = _unit(pivots)
    k, width = min(nearest, len(pivots)), pivots.shape[1]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _scaled(_matrix(b.column("vec"), width, float))
            far = -(_unit(m) @ pivots.T)
            near = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
            perm = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), pa.array(near.ravel()))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, width, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), vec, perm], ["vec_id", "vec", "perm"])

    return vectors.mapInArrow(index, "vec_id long, vec array<double>, perm array<int>")


class Files:
    """Inverted files of a block: for each pivot the rows that have it among their nearest, and its position there."""

    def __init__(self, perm: np.ndarray, n_pivots: int):
        self.n, self.k = perm.shape
        order = np.argsort(perm.ravel(), kind="stable")
        self.rows, self.position = (order // self.k).astype(np.int32), (order % self.k).astype(np.int32)
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(perm.ravel(), minlength=n_pivots))))

    def found(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in any file of the order ``of``, and their footrule; a pivot missing from one side stands at the end."""
        a, b = self.ends[of], self.ends[of + 1]
        at = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
        place = np.repeat(np.arange(self.k), b - a)
        saved = (self.k - place) + (self.k - self.position[at]) - np.abs(self.position[at] - place)  # at least 1
        total = np.bincount(self.rows[at], weights=saved, minlength=self.n).astype(np.int64)
        rows = np.flatnonzero(total)
        return rows, self.k * (self.k + 1) - total[rows]

    def candidates(self, of: np.ndarray, rerank: float) -> np.ndarray:
        """The share ``rerank`` of rows found with the smallest footrule; at least ``AT_LEAST`` rows if the block has them, the first of the others if too few are found."""
        rows, far = self.found(of)
        depth = min(self.n, max(AT_LEAST, int(np.ceil(rerank * len(rows)))))
        if depth >= len(rows):
            if depth == len(rows):
                return rows
            others = np.ones(self.n, dtype=bool)
            others[rows] = False
            return np.concatenate((rows, np.flatnonzero(others)[: depth - len(rows)]))
        return rows[np.argpartition(far * self.n + rows, depth - 1)[:depth]]


def footrule(perm: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Footrule between each row of ``perm`` and the order ``of``."""
    files = Files(perm, int(max(perm.max(initial=0), of.max(initial=0))) + 1)
    out = np.full(files.n, files.k * (files.k + 1), dtype=np.int64)
    rows, far = files.found(of)
    out[rows] = far
    return out


def search(index: DataFrame, queries: DataFrame, n_pivots: int, k: int = 5, block: int = BLOCK, rerank: float = RERANK) -> DataFrame:
    """The ``k`` nearest found per query: ``query_id, rank, vec_id, score``.

    ``index`` and ``queries`` are results of ``permutations``. A query's own vec_id is no candidate. Ties go to the smaller vec_id.
    In every block the share ``rerank`` of the rows found is reranked: a share, not a number, so that it means the same at every size.
    """
    n = index.count()
    n_blocks = max(1, -(-n // block))
    n_query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    row = F.struct("vec_id", "vec", "perm")
    blocks = index.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("b")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    asked = (
        queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).alias("q")).agg(F.collect_list(row).alias("asked"))
        .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                here, there = (batch.column(c).slice(i, 1).flatten() for c in ("rows", "asked"))
                ids, want = here.field("vec_id").to_numpy(zero_copy_only=False), there.field("vec_id").to_numpy(zero_copy_only=False)
                vec, q_vec = (_matrix(x.field("vec"), len(x.field("vec")[0]), float) for x in (here, there))
                perm, q_perm = (_matrix(x.field("perm"), len(x.field("perm")[0]), np.int32) for x in (here, there))
                norm, q_norm = np.linalg.norm(vec, axis=1), np.linalg.norm(q_vec, axis=1)
                files = Files(perm, n_pivots)
                found: list[list[np.ndarray]] = [[], [], []]
                for j, query in enumerate(want):
                    near = files.candidates(q_perm[j], rerank)
                    near = near[ids[near] != query]
                    score = (vec[near] @ q_vec[j]) / (norm[near] * q_norm[j])
                    best = np.lexsort((ids[near], -score))[:k]
                    found[0].append(np.full(len(best), query))
                    found[1].append(ids[near][best])
                    found[2].append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], ["query_id", "vec_id", "score"])

    pairs = blocks.join(asked.hint("shuffle_hash"), "b").select("rows", "asked")
    hits = pairs.mapInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query, k: int = 5, n_pivots: int = N_PIVOTS, nearest_pivots: int = NEAREST, rerank: float = RERANK, block: int = BLOCK) -> DataFrame:
    """Index all usable vectors and search the rows where ``is_query`` holds. No usable vector: no rows.

    The pivots are the ``n_pivots`` usable vectors first in the order of a hash of vec_id, at most a third of all; equal ones count once.
    """
    vectors = materialize(usable(df))
    drawn = [tuple(r.vec) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("vec").collect()]
    drawn = list(dict.fromkeys(drawn))
    pivots = drawn[: max(1, vectors.count() // 3)]
    if not pivots:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = materialize(permutations(vectors, np.array(pivots), nearest_pivots))
    return search(index, index.where(is_query), len(pivots), k, block, rerank)

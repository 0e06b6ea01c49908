"""Exact histogram of encoded lengths, and what every context limit makes of it.

Documents are reduced to their number of tokens where they are read; a count per length is all that is shuffled.
Suffix sums over the histogram then answer, for a limit L: how many documents and tokens are at or above it, what a
truncation at L keeps, and which quantile L is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridobs.llm._shared import materialize
from gridobs.llm.tokens import default_path, encode

#: Lengths per block of the two-level running sums.
BLOCK = 1024


def encoded_lengths(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``n_tokens`` of every row; a null or empty text has none."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(encode(t.as_py(), path)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return df.select(F.col(text_col)).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``length, n_docs``: exact, one row per length that occurs."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, read as a context limit L, the exact answers.

    Columns: ``length, n_docs``; ``docs_at_least, tokens_at_least`` (suffix sums); ``docs_total, tokens_total``;
    ``truncated_tokens`` (tokens left if every document is cut to L); ``docs_at_most`` and ``share_at_most`` (L is the quantile of every share above the
    previous row's and up to this). Between two lengths the answers follow linearly, see ``at_limit``. Empty table: no rows.
    The histogram is worked out once and kept. Running sums go over blocks of lengths and then over the blocks, so no task sees more than ``BLOCK`` lengths or all blocks' sums.
    """
    h = materialize(histogram).withColumn("_block", F.floor(F.col("length") / BLOCK)).withColumn("_tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    ahead = Window.partitionBy(F.lit(0)).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        F.col("_block").alias("_b"), F.coalesce(F.sum("_d").over(ahead), F.lit(0)).alias("_d_after"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_t_after"),
        F.sum("_d").over(every).alias("docs_total"), F.sum("_t").over(every).alias("tokens_total"),
    )
    up = Window.partitionBy("_block").orderBy(F.desc("length"))
    return (
        h.withColumn("_d_in", F.sum("n_docs").over(up)).withColumn("_t_in", F.sum("_tokens").over(up))
        .join(blocks, F.col("_block") == F.col("_b"))
        .select(
            "length", "n_docs", (F.col("_d_in") + F.col("_d_after")).alias("docs_at_least"), (F.col("_t_in") + F.col("_t_after")).alias("tokens_at_least"),
            "docs_total", "tokens_total",
        )
        .withColumn("truncated_tokens", F.col("tokens_total") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))
        .withColumn("docs_at_most", F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs"))
        .withColumn("share_at_most", F.col("docs_at_most") / F.col("docs_total"))
    )


def at_limit(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_over, truncated_tokens`` for any list of limits, from the histogram alone."""
    asked = F.explode(F.array(*(F.lit(x).cast("long") for x in limits)))
    return (
        histogram.withColumn("limit", asked).groupBy("limit")
        .agg(
            F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
            F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_tokens"),
        )
    )

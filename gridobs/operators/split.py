"""Splits by year, balancing across cells and regions, training matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridobs.operators.grid import K
from gridobs.operators.quantiles import exact_quantiles


def _years(df: DataFrame) -> list[int]:
    return [r.year for r in df.where("year IS NOT NULL").select("year").distinct().orderBy("year").collect()]


def year_map(years: Sequence[int], ratios: tuple[float, float] = (0.7, 0.15)) -> dict[int, str]:
    """First years train, next test, last validation: floors of the ratios, at least one each as far as the years go."""
    n = len(years)
    train = max(1, int(ratios[0] * n + 1e-9))
    test = max(1, int(ratios[1] * n + 1e-9))
    val = max(1, n - train - test)
    out = {y: "gap" for y in years}
    for y in years[:train]:
        out[y] = "train"
    for y in years[train : train + test]:
        out[y] = "test"
    for y in years[train + test :][-val:]:
        out[y] = "val"
    return out


def attach_split(df: DataFrame, years: dict[int, str]) -> DataFrame:
    out: Column = F.lit("gap")
    for name in dict.fromkeys(years.values()):
        out = F.when(F.col("year").isin([y for y, s in years.items() if s == name]), name).otherwise(out)
    return df.withColumn("split", out)


def temporal_split(df: DataFrame, ratios: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    return attach_split(df, year_map(_years(df), ratios))


def last_years_split(df: DataFrame) -> DataFrame:
    """Last year test, the one before validation, the rest train; with fewer than three years all train."""
    years = _years(df)
    return attach_split(df, {y: "train" for y in years} | ({years[-1]: "test", years[-2]: "val"} if len(years) >= 3 else {}))


def cap_per_cell(df: DataFrame, k: int = 15, value: str = "xco2_anomaly", ties: Sequence[str] = ("date",)) -> DataFrame:
    """At most ``k`` rows of each cell, those with the largest absolute value; NULL last, then by ``ties``."""
    order = Window.partitionBy(*K).orderBy(F.desc_nulls_last(F.abs(value)), *ties)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def undersample_targets(df: DataFrame, ref: str = "Korea_Japan", multipliers: dict[str, float] | None = None) -> DataFrame:
    """``region, split, n, keep``: rows and rows to keep of each region and split; all of them where the reference region is empty or the region small."""
    # How many times the reference region's rows each region may have.
    multipliers = multipliers or {"West_China": 3.0, "East_China": 2.0, "Korea_Japan": 1.0, "Far_East": 1.0}
    n = df.groupBy("region", "split").agg(F.count("*").alias("n"))
    factor: Column = F.lit(1.0)
    for name, m in multipliers.items():
        factor = F.when(F.col("region") == name, m).otherwise(factor)
    whole = F.sum("n").over(Window.partitionBy("region"))
    reference = F.sum(F.when(F.col("region") == ref, F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    target = reference * factor
    keep = F.greatest(F.lit(1).cast("long"), F.bround(target * F.col("n") / whole).cast("long"))
    return n.withColumn("keep", F.when((reference > 0) & (whole > target), keep).otherwise(F.col("n")))


def undersample(df: DataFrame, key: Sequence[str], ref: str = "Korea_Japan", multipliers: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Keep exactly the targeted number of rows of each region and split, drawn by a hash of ``key`` (unique), so it is repeatable.

    There are few groups, so each is ranked in 4096 ranges of the hash: counts tell in which range the draw ends, ranges before it are kept whole.
    """
    targets = undersample_targets(df, ref, multipliers).withColumnsRenamed({"region": "_r", "split": "_s", "n": "_n", "keep": "_keep"})
    draw = F.xxhash64(F.lit(seed), *key)
    rows = df.withColumn("_draw", draw).withColumn("_range", F.shiftright("_draw", 52))
    ranges = rows.groupBy(F.col("region").alias("_r2"), F.col("split").alias("_s2"), F.col("_range").alias("_range2")).agg(F.count("*").alias("_in"))
    before = F.sum("_in").over(Window.partitionBy("_r2", "_s2").orderBy("_range2")) - F.col("_in")
    ranges = ranges.withColumn("_before", before).join(F.broadcast(targets), F.col("_r2").eqNullSafe(F.col("_r")) & F.col("_s2").eqNullSafe(F.col("_s")))
    ranges = ranges.where("_before < _keep").select("_r2", "_s2", "_range2", "_in", "_before", "_keep")
    # at most 4096 rows for each of a few groups
    rows = rows.join(F.broadcast(ranges), F.col("region").eqNullSafe(F.col("_r2")) & F.col("split").eqNullSafe(F.col("_s2")) & (F.col("_range") == F.col("_range2")))
    rank = F.row_number().over(Window.partitionBy("_r2", "_s2", "_range").orderBy("_draw", *key))
    rows = rows.withColumn("_rank", F.when(F.col("_before") + F.col("_in") > F.col("_keep"), rank).otherwise(0)).where(F.col("_before") + F.col("_rank") <= F.col("_keep"))
    return rows.drop("_draw", "_range", "_r2", "_s2", "_range2", "_in", "_before", "_keep", "_rank")


def train_matrix(df: DataFrame, features: Sequence[str], target: str = "xco2_anomaly", split: str = "train") -> DataFrame:
    """Training rows: features with NULL replaced by the training median, target as double."""
    rows = df.where(F.col("split") == split)
    fill = {f: m for f, (m,) in exact_quantiles(rows, {f: [0.5] for f in features}).items()}
    return rows.select(*(F.coalesce(F.col(f).cast("double"), F.lit(fill[f]).cast("double")).alias(f) for f in features), F.col(target).cast("double").alias(target))

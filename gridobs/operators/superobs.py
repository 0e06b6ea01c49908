"""One robust value per day and cell, with a bootstrap error."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridobs.operators.grid import K
from gridobs.operators.quantiles import values_at_ranks
from gridobs.operators.tables import cut, with_rows_of

#: Soundings of a date and cell that are collected into one row.
FEW = 10_000

MEANS = ("era5_wind_speed", "era5_blh", "era5_u10", "era5_v10", "latitude", "longitude", "population_density", "odiac_emission")


@lru_cache(maxsize=4096)
def middle_ranks(n: int, resamples: int = 100, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (from 0) of the two middle values of each resample of ``n`` sorted values: a pure function of size, number of resamples and seed, of the same cost at every size.

    A resample draws n ranks with equal chance. The k-th smallest of n uniform draws is a beta variate, the one after it lies a beta share of the rest higher, and
    the rank of a draw grows with it, so nothing has to be drawn n times.
    """
    rng = np.random.default_rng([seed, n])
    k = (n + 1) // 2
    low = rng.beta(k, n - k + 1, resamples)
    high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k, resamples)
    return tuple(np.minimum((u * n).astype(np.int64), n - 1) for u in (low, high))


def bootstrap_errors(values: pa.ListArray, resamples: int, seed: int) -> np.ndarray:
    """Sample spread of the resamples' medians for each list of sorted values; of two values their own, NaN below two. Lists of one length are worked on together."""
    size = values.value_lengths().to_numpy(zero_copy_only=False)
    flat, start = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    out = np.full(len(values), np.nan)
    for n in np.unique(size[size > 1]).tolist():
        at = np.flatnonzero(size == n)
        low, high = middle_ranks(n, resamples, seed) if n > 2 else (np.arange(2), np.arange(2))
        step = max(1, 1_000_000 // len(low))
        for part in np.split(at, range(step, len(at), step)):
            first = flat[start[part]][:, None]  # equal values have a spread of exactly 0
            out[part] = np.std((flat[start[part][:, None] + low] - first + flat[start[part][:, None] + high] - first) / 2, axis=1, ddof=1)
    return out


def _middle(n: Column) -> Column:
    return F.array(F.floor((n - 1) / 2), F.floor(n / 2))


def _large_groups(df: DataFrame, large: DataFrame, keys: Sequence[str], resamples: int, seed: int, few: int) -> DataFrame:
    """``keys, _x, _no2, _error`` of the groups in ``large`` (``keys, _n, _m``: values of xco2 and no2), whose values are found by rank, not collected."""
    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = [middle_ranks(int(n), resamples, seed) if n > 2 else (np.zeros(0, np.int64),) * 2 for n in b.column("_n").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([d[k] for d in drawn], pa.list_(pa.int64())) for k in range(2))], [*b.schema.names, "_low", "_high"])

    types = ", ".join(f"`{c}` {t}" for c, t in large.dtypes)
    large = cut(large.mapInArrow(ranks, f"{types}, _low array<long>, _high array<long>"))

    def at(column: str, wanted: Column) -> DataFrame:
        x = F.col(column).cast("double")
        rows = cut(with_rows_of(df.where(x.isNotNull()).select(*keys, x.alias("_x")), large.select(*keys), keys, "left_semi"))
        found = values_at_ranks(rows, large.select(*keys, F.explode(F.array_distinct(wanted)).alias("_rank")), keys, few)
        return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias(f"_{column}"))

    known = large.join(at("xco2", F.concat("_low", "_high", _middle(F.col("_n")))), keys, "left").join(at("tropomi_no2", _middle(F.col("_m"))), keys, "left")
    value = lambda of, r: F.try_element_at(of, r)
    median = lambda of, n: (value(of, _middle(n)[0]) + value(of, _middle(n)[1])) / 2
    first = value("_xco2", _middle(F.col("_n"))[0])
    medians = F.zip_with("_low", "_high", lambda a, b: (value("_xco2", a) - first + value("_xco2", b) - first) / 2)
    total = lambda f: F.aggregate(medians, F.lit(0.0), lambda s, m: s + f(m))
    n = F.size("_low")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (total(lambda m: m * m) - total(lambda m: m) * total(lambda m: m) / n) / (n - 1))))
    return known.select(*keys, median("_xco2", F.col("_n")).alias("_x"), median("_tropomi_no2", F.col("_m")).alias("_no2"), spread.alias("_error"))


def super_observation(df: DataFrame, by: Sequence[str] = (), with_error: bool = True, resamples: int = 100, seed: int = 42, few: int = FEW) -> DataFrame:
    """Per date and cell (and ``by``, e.g. a sensor): medians of xco2 and no2, means of the rest, ``n_soundings``, ``xco2_bootstrap_std``.

    The error is NULL below two values, the sample spread for two, and from three on the spread of the medians of the resamples. Values of a group are sorted, so
    the error doesn't depend on the order of rows; the resamples' ranks are a function of the group's size, drawn where they are used. Groups of more than ``few`` soundings
    are not collected: their medians and the values at their ranks are found by narrowing, which gives the same numbers. NULL keys are dropped.
    """
    keys = ["date", *K, *by]
    df = df.dropna(subset=keys)
    means = [F.avg(c).alias(c) for c in MEANS if c in df.columns]
    if not with_error:
        return df.groupBy(*keys).agg(F.median("xco2").alias("xco2"), F.median("tropomi_no2").alias("tropomi_no2"), *means, F.count("xco2").alias("n_soundings"))
    x, y = F.col("xco2").cast("double"), F.col("tropomi_no2").cast("double")
    large = df.groupBy(*keys).agg(F.count(x).alias("_n"), F.count(y).alias("_m")).where(F.greatest("_n", "_m") > few)
    large = cut(large)
    some = large.limit(1).count()
    rows = df
    if some:
        rows = with_rows_of(df, large.select(*keys, F.lit(True).alias("_large")), keys, "left")
        x, y = (F.when(F.col("_large").isNull(), c) for c in (x, y))
    out = rows.groupBy(*keys).agg(*means, F.count("xco2").alias("n_soundings"), F.sort_array(F.collect_list(x)).alias("_v"), F.sort_array(F.collect_list(y)).alias("_w"))

    @F.arrow_udf("double")
    def error(values: pa.Array) -> pa.Array:
        return pa.array(bootstrap_errors(values, resamples, seed), from_pandas=True)

    half = lambda v, k: F.get(v, F.floor((F.size(v) - k) / 2).cast("int"))
    median = lambda v: F.when(F.size(v) > 0, (half(v, 1) + half(v, 0)) / 2)
    columns = [median("_v").alias("xco2"), median("_w").alias("tropomi_no2"), error("_v").alias("xco2_bootstrap_std")]
    if some:
        out = out.withColumn("_e", columns[2]).join(_large_groups(df, large, keys, resamples, seed, few), keys, "left")
        columns = [F.coalesce(a, c).alias(n) for a, c, n in zip(("_x", "_no2", "_error"), (*columns[:2], F.col("_e")), ("xco2", "tropomi_no2", "xco2_bootstrap_std"))]
    return out.select(*keys, *columns[:2], *(c for c in MEANS if c in df.columns), "n_soundings", columns[2])


def mode_land_counts(df: DataFrame) -> DataFrame:
    """Soundings per operation mode and surface, with names, and whether it is glint over land."""
    mode = F.when(F.col("snd_operation_mode") == 0, "Nadir").when(F.col("snd_operation_mode") == 1, "Glint").when(F.col("snd_operation_mode") == 2, "Target").otherwise("Other")
    land = F.when(F.col("snd_land_water_indicator") == 0, "Land").when(F.col("snd_land_water_indicator") == 1, "Ocean").otherwise("Coast")
    return df.groupBy(mode.alias("mode"), land.alias("surface")).agg(F.count("*").alias("n")).withColumn("glint_over_land", (F.col("mode") == "Glint") & (F.col("surface") == "Land"))


def observation_density(df: DataFrame) -> DataFrame:
    return df.groupBy(*K).agg(F.sum("n_soundings").alias("n_soundings")).withColumn("log10_n", F.when(F.col("n_soundings") > 0, F.log10("n_soundings")))


def sensor_comparison(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("OCO-2", "OCO-3")) -> DataFrame:
    """Per sensor: super-observations, distinct cells, soundings, and the second's share of the first in percent."""
    both = a.select(*K, "n_soundings", F.lit(names[0]).alias("sensor")).unionByName(b.select(*K, "n_soundings", F.lit(names[1]).alias("sensor")))
    of = lambda s: F.col("sensor") == s
    cell = F.struct(*K)
    one = both.agg(*(x for i, s in enumerate(names) for x in (
        F.count_if(of(s)).alias(f"rows{i}"), F.count_distinct(F.when(of(s), cell)).alias(f"cells{i}"), F.coalesce(F.sum(F.when(of(s), F.col("n_soundings"))), F.lit(0)).alias(f"n{i}"),
    )))
    rows = [F.struct(F.lit(s).alias("sensor"), *(F.col(f"{k}{i}").alias(o) for k, o in (("rows", "n_rows"), ("cells", "n_cells"), ("n", "n_soundings"))),
                     (F.lit(100.0) * F.try_divide(F.col(f"rows{i}"), F.col("rows0"))).alias("pct_rows"), (F.lit(100.0) * F.try_divide(F.col(f"n{i}"), F.col("n0"))).alias("pct_soundings")) for i, s in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

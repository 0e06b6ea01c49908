"""Background removal: seasonal cycle and yearly deviation by cell, with regional and global fallbacks, or by day and latitude row.

All lookups are at most one row per cell and month; they are broadcast when Spark finds them small and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridobs.functions.columns import REGIONS, Region
from gridobs.operators.grid import K
from gridobs.operators.tables import cut


_MONTH = ["eaic_region", *K, "year", "month"]


def _per_region(regions: tuple[Region, ...], what: str, default: int) -> Column:
    out = F.lit(default)
    for r in regions:
        out = F.when(F.col("eaic_region") == r.name, getattr(r, what)).otherwise(out)
    return out


def valid_cells(df: DataFrame, min_months: int = 12) -> DataFrame:
    """Cells with at least that many distinct year-months."""
    return df.groupBy(*K).agg(F.count_distinct("year_month").alias("n_months")).where(F.col("n_months") >= min_months).select(*K)


def valid_cells_by_region(df: DataFrame, regions: tuple[Region, ...] = REGIONS) -> DataFrame:
    """The same with the region's own threshold; a cell counts in the region of its rows."""
    return df.groupBy("eaic_region", *K).agg(F.count_distinct("year_month").alias("n_months")).where(F.col("n_months") >= _per_region(regions, "min_months", 12)).select(*K).distinct()


def monthly_climatology(df: DataFrame, cells: DataFrame, value: str = "xco2") -> DataFrame:
    """``lat_idx, lon_idx, month, clim`` of valid cells."""
    return df.join(cells, K, "left_semi").groupBy(*K, "month").agg(F.avg(value).alias("clim"))


def yearly_deviation(df: DataFrame, cells: DataFrame, min_obs: int | Column = 5, value: str = "xco2") -> DataFrame:
    """``lat_idx, lon_idx, year, delta``: a valid cell's mean of the year minus its mean of all time, from at least ``min_obs`` values."""
    rows = df.join(cells, K, "left_semi")
    need = min_obs if isinstance(min_obs, Column) else F.lit(min_obs)
    by_year = rows.groupBy(*K, "year").agg(F.avg(value).alias("_year"), F.count(value).alias("_n"), F.sum(value).alias("_sum"), F.max(need).alias("_need"))
    everything = Window.partitionBy(*K)
    # the mean of all time from the yearly sums: a window over a few rows per cell, not over the observations
    out = by_year.withColumn("_all", F.try_divide(F.sum("_sum").over(everything), F.sum("_n").over(everything)))
    return out.where(F.col("_n") >= F.col("_need")).select(*K, "year", (F.col("_year") - F.col("_all")).alias("delta"))


def yearly_deviation_by_region(df: DataFrame, cells: DataFrame, regions: tuple[Region, ...] = REGIONS) -> DataFrame:
    return yearly_deviation(df, cells, _per_region(regions, "min_rows", 5))


def region_climatology(df: DataFrame) -> DataFrame:
    return df.groupBy("eaic_region", "month").agg(F.avg("xco2").alias("region_clim"))


def region_deviation(df: DataFrame) -> DataFrame:
    by_year = df.groupBy("eaic_region", "year").agg(F.avg("xco2").alias("_year"), F.sum("xco2").alias("_sum"), F.count("xco2").alias("_n"))
    w = Window.partitionBy("eaic_region")
    return by_year.select("eaic_region", "year", (F.col("_year") - F.try_divide(F.sum("_sum").over(w), F.sum("_n").over(w))).alias("region_delta"))


def global_climatology(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(F.avg("xco2").alias("global_clim"))


def apply_baseline(df: DataFrame, clim: DataFrame, delta: DataFrame) -> DataFrame:
    """Add ``xco2_baseline`` (climatology plus deviation) and ``xco2_anomaly``; rows without both are dropped. Works across sensors alike."""
    out = df.join(clim, [*K, "month"], "left").join(delta, [*K, "year"], "left").withColumn("xco2_baseline", F.col("clim") + F.col("delta"))
    return out.withColumn("xco2_anomaly", F.col("xco2") - F.col("xco2_baseline")).where("xco2_anomaly IS NOT NULL").drop("clim", "delta")


def _with_tiers(df: DataFrame, grid_clim: DataFrame, region_clim: DataFrame, global_clim: DataFrame, grid_delta: DataFrame, region_delta: DataFrame) -> DataFrame:
    """Add ``xco2_baseline`` and ``baseline_tier`` by region, cell, year and month."""
    out = df.join(grid_clim, [*K, "month"], "left").join(region_clim, ["eaic_region", "month"], "left").join(global_clim, "month", "left")
    out = out.join(grid_delta, [*K, "year"], "left").join(region_delta, ["eaic_region", "year"], "left")
    tier = F.when(F.col("clim").isNotNull(), 10).when(F.col("region_clim").isNotNull(), 20).when(F.col("global_clim").isNotNull(), 30).otherwise(0) + F.when(F.col("delta").isNotNull(), 1).otherwise(2)
    base = F.coalesce("clim", "region_clim", "global_clim") + F.coalesce("delta", "region_delta", F.lit(0.0))
    return out.withColumn("xco2_baseline", base).withColumn("baseline_tier", tier.cast("int")).drop("clim", "region_clim", "global_clim", "delta", "region_delta")


def _anomaly(df: DataFrame, with_tier: bool) -> DataFrame:
    out = df.withColumn("xco2_anomaly", F.col("xco2") - F.col("xco2_baseline")).where("xco2_anomaly IS NOT NULL")
    return out if with_tier else out.drop("baseline_tier")


def apply_tiered_baseline(df: DataFrame, grid_clim: DataFrame, region_clim: DataFrame, global_clim: DataFrame, grid_delta: DataFrame, region_delta: DataFrame, with_tier: bool = True) -> DataFrame:
    """Climatology of the cell, else the region, else all; deviation of the cell's year, else the region's, else 0.

    ``baseline_tier`` is ten times the climatology's tier (1, 2, 3; 0 if none) plus the deviation's (1 or 2).
    """
    return _anomaly(_with_tiers(df, grid_clim, region_clim, global_clim, grid_delta, region_delta), with_tier)


def month_sums(df: DataFrame, value: str = "xco2") -> DataFrame:
    """``eaic_region, lat_idx, lon_idx, year, month, year_month, sum, n``: what every lookup of the tiers can be made of."""
    return df.groupBy(*_MONTH, "year_month").agg(F.sum(value).alias("sum"), F.count(value).alias("n"))


def tier_lookups(sums: DataFrame, regions: tuple[Region, ...] = REGIONS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The five lookups of ``apply_tiered_baseline`` from ``month_sums``."""
    mean = F.try_divide(F.sum("sum"), F.sum("n"))
    valid = sums.join(valid_cells_by_region(sums, regions), K, "left_semi")

    def deviation(df: DataFrame, keys: list[str], name: str, need: Column) -> DataFrame:
        by_year = df.groupBy(*keys, "year").agg(F.sum("sum").alias("_sum"), F.sum("n").alias("_n"), F.max(need).alias("_need"))
        w = Window.partitionBy(*keys)
        delta = F.try_divide("_sum", "_n") - F.try_divide(F.sum("_sum").over(w), F.sum("_n").over(w))
        return by_year.withColumn(name, delta).where("_n >= _need").select(*keys, "year", name)

    return (
        valid.groupBy(*K, "month").agg(mean.alias("clim")), sums.groupBy("eaic_region", "month").agg(mean.alias("region_clim")), sums.groupBy("month").agg(mean.alias("global_clim")),
        deviation(valid, list(K), "delta", _per_region(regions, "min_rows", 5)), deviation(sums, ["eaic_region"], "region_delta", F.lit(0)),
    )


def tiered_anomaly(df: DataFrame, regions: tuple[Region, ...] = REGIONS, apply_to: DataFrame | None = None, with_tier: bool | None = None) -> DataFrame:
    """Fit all lookups on ``df`` (labelled, with calendar columns) and apply them to it, or to another sensor's rows (then without ``baseline_tier`` unless asked for).

    Baseline and tier depend on region, cell, year and month alone. So the observations are summed by these once, all lookups and the choice between them are made on the sums, and the
    observations are joined once with the result.
    """
    sums = cut(month_sums(df))
    rows = df if apply_to is None else apply_to
    asked = (sums if apply_to is None else rows).select(*_MONTH).distinct()
    chosen = _with_tiers(asked, *tier_lookups(sums, regions)).withColumnsRenamed({k: f"_{k}" for k in _MONTH})
    same = F.lit(True)
    for k in _MONTH:
        same = same & rows[k].eqNullSafe(F.col(f"_{k}"))
    return _anomaly(rows.join(chosen, same).drop(*(f"_{k}" for k in _MONTH)), apply_to is None if with_tier is None else with_tier)


def tier_distribution(df: DataFrame) -> DataFrame:
    """``baseline_tier, n, pct``; the total comes from the few groups, not from a second pass."""
    n = df.groupBy("baseline_tier").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def daily_zonal_background(df: DataFrame, q: float = 0.1, least: int = 5) -> DataFrame:
    """Add ``xco2_background`` and ``xco2_anomaly``: per date and latitude row, the median over its cleanest rows.

    Clean are rows whose emission is at most the group's ``q`` quantile; if emissions are absent or all the same, or fewer than ``least`` rows are
    clean, all rows count. Rows without an anomaly are dropped. Window and aggregation share one exchange.
    """
    keys = ["date", "lat_idx"]
    df = df.dropna(subset=keys)
    if "odiac_emission" not in df.columns:
        found = df.groupBy(*keys).agg(F.median("xco2").alias("xco2_background"))
    else:
        threshold = F.percentile("odiac_emission", F.lit(q)).over(Window.partitionBy(*keys))
        clean = F.col("odiac_emission") <= F.col("_threshold")
        found = df.withColumn("_threshold", threshold).groupBy(*keys).agg(
            F.median("xco2").alias("_all"), F.median(F.when(clean, F.col("xco2"))).alias("_clean"), F.count_if(clean).alias("_n"),
            (F.min("odiac_emission") < F.max("odiac_emission")).alias("_varied"),
        )
        found = found.select(*keys, F.when(F.col("_varied") & (F.col("_n") >= least), F.col("_clean")).otherwise(F.col("_all")).alias("xco2_background"))
    return df.join(found, keys).withColumn("xco2_anomaly", F.col("xco2") - F.col("xco2_background")).where("xco2_anomaly IS NOT NULL")


def monthly_cube(df: DataFrame, values: tuple[str, ...] = ("xco2_anomaly", "xco2", "xco2_baseline")) -> DataFrame:
    return df.groupBy("year", "month", *K).agg(*(F.avg(v).alias(v) for v in values))


def residual_trend(df: DataFrame, by: str = "lat_band", values: list | None = None) -> DataFrame:
    """Mean anomaly per year (rows) and band or region (columns), to 3 digits."""
    pivoted = df.groupBy("year").pivot(by, values) if values else df.groupBy("year").pivot(by)
    return pivoted.agg(F.round(F.avg("xco2_anomaly"), 3))


def residual_check(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row: the overall mean anomaly and whether it is near 0."""
    return df.agg(F.avg("xco2_anomaly").alias("mean_anomaly")).withColumn("near_zero", F.abs("mean_anomaly") < limit)

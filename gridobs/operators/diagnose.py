"""Regional bias, cell load, sector totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridobs.operators.grid import K


def _whole() -> WindowSpec:
    """One window over everything: for tables of a few groups only."""
    return Window.partitionBy(F.lit(0))


def region_counts(df: DataFrame, by: str = "region") -> DataFrame:
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(_whole()))


def region_latband_crosstab(df: DataFrame, regions: list[str], by: str = "region", band: str = "lat_band") -> DataFrame:
    """Rows per latitude band and region with a total per band and, as band NULL, over all bands."""
    n = df.groupBy(band, by).agg(F.count("*").alias("n"))
    columns = [F.coalesce(F.sum(F.when(F.col(by) == r, F.col("n"))), F.lit(0)).alias(r) for r in regions]
    return n.rollup(band).agg(*columns, F.sum("n").alias("total"))


def cell_load(df: DataFrame, by: str = "region") -> DataFrame:
    return df.groupBy(*K, by).agg(F.count("*").alias("n"))


def cell_load_stats(df: DataFrame, by: str = "region") -> DataFrame:
    """Per region: cells, and mean, median, maximum and 95 % quantile of their rows."""
    return cell_load(df, by).groupBy(by).agg(
        F.count("*").alias("n_cells"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.max("n").alias("max"), F.percentile("n", F.lit(0.95)).alias("p95")
    )


def gini(df: DataFrame, by: str = "region") -> DataFrame:
    """One row: the Gini coefficient of the regions' row counts."""
    n = df.groupBy(by).agg(F.count("*").cast("double").alias("x"))
    ranked = n.withColumn("i", F.row_number().over(_whole().orderBy("x", by)))
    k = F.count("*")
    return ranked.agg((F.lit(2.0) * F.sum(F.col("i") * F.col("x")) / (k * F.sum("x")) - (k + 1) / k).alias("gini"))


def recommended_cap(df: DataFrame, by: str = "region") -> DataFrame:
    return cell_load(df, by).agg(F.percentile("n", F.lit(0.95)).cast("int").alias("cap"))


def densest_cells(df: DataFrame, n: int = 20, by: str = "region") -> DataFrame:
    """The ``n`` cells of most rows, with the rounded mean place."""
    load = df.groupBy(*K, by).agg(F.count("*").alias("n"), F.round(F.avg("latitude"), 2).alias("lat"), F.round(F.avg("longitude"), 2).alias("lon"))
    return load.orderBy(F.desc("n"), *K, by).limit(n)


def sector_totals(df: DataFrame, flux: str = "fluxes") -> DataFrame:
    return df.groupBy("year", "sector").agg(F.sum(flux).alias("total"), F.count("*").alias("n"))

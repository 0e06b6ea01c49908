"""Correlation with false-discovery control, scaling, error measures and distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridobs.functions.columns import Grid, lat_band
from gridobs.functions.special import normal_quantile, pearson_pvalue
from gridobs.operators.grid import K
from gridobs.operators.quantiles import exact_quantiles, grouped_quantiles


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both exist; NULL for a constant side, inside [-1, 1]."""
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def cell_correlation(df: DataFrame, x: str = "tropomi_no2", y: str = "xco2_anomaly", min_obs: int = 10, with_p: bool = True) -> DataFrame:
    """Per cell of at least ``min_obs`` rows: ``n, n_valid, r`` and ``p`` (NULL unless ``min_obs`` rows have both)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    out = df.groupBy(*K).agg(F.count("*").alias("n"), F.count_if(both).alias("n_valid"), pearson(a, b).alias("r")).where(F.col("n") >= min_obs)
    out = out.withColumn("r", F.when(F.col("n_valid") >= min_obs, F.col("r")))
    return out.withColumn("p", pearson_pvalue("r", "n_valid")) if with_p else out


#: Value ranges that one pass over the p-values tells apart.
RANGES = 1_000


def fdr_by(df: DataFrame, p: str = "p", alpha: float = 0.05, ranges: int = RANGES) -> DataFrame:
    """Add ``significant`` by Benjamini, Hochberg and Yekutieli; rows without p count in m and are never significant.

    Only the largest p that passes is looked for. A pass over the values counts them in ``ranges`` equal ranges, with the least and greatest value of each: the greatest value's rank is
    then known, so it passes or not, and a range whose least value would not even pass with that rank is out. From above, the first range that passes ends the search; one that is open is
    looked at in the same way by itself. No value is ranked, plans and what reaches the driver stay the same at any size, and three passes tell a billion values apart.
    """
    m = df.count()
    if not m:
        return df.withColumn("significant", F.lit(False))
    harmonic = sum(1.0 / i for i in range(1, m + 1)) if m < 10**6 else 0.5772156649015329 + math.log(m) + 0.5 / m
    values = df.select(F.col(p).cast("double").alias("_p")).where("_p IS NOT NULL AND NOT isnan(_p)")

    def passes(x: float, rank: int) -> bool:
        return x <= rank / m * (alpha / harmonic)

    def largest(low: float, high: float, before: int) -> float | None:
        """The largest value of the range that passes, with ``before`` values below the range."""
        share = (F.col("_p") - F.lit(low)) / F.lit(high - low) if high > low else F.lit(0.0)
        place = F.least(F.lit(ranges - 1), F.floor(share * F.lit(ranges)))
        inside = values.where(F.col("_p").between(low, high)).groupBy(place.alias("place"))
        rows = sorted(inside.agg(F.count("*").alias("n"), F.min("_p").alias("least"), F.max("_p").alias("most")).collect())
        below = before + sum(r.n for r in rows)
        for r in reversed(rows):  # at most ``ranges``
            if passes(r.most, below):
                return r.most
            if r.least < r.most and passes(r.least, below) and (found := largest(r.least, r.most, below - r.n)) is not None:
                return found
            below -= r.n
        return None

    least = values.agg(F.min("_p").alias("x")).first().x
    limit = largest(least, alpha / harmonic, 0) if least is not None and least <= alpha / harmonic else None
    return df.withColumn("significant", F.lit(False) if limit is None else F.coalesce((F.col(p) <= F.lit(limit)) & ~F.isnan(F.col(p).cast("double")), F.lit(False)))


def correlation_summary(df: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """One row: mean and median r, cells from |r| 0.3 and 0.5, and number, share, significance and place (latitude and longitude of the centres) of cells from r 0.5."""
    r, strong = F.col("r"), F.col("r") >= 0.5
    sig = F.col("significant") if "significant" in df.columns else F.lit(False)
    place = {"lat": F.when(strong, grid.lat_center("lat_idx")), "lon": F.when(strong, grid.lon_center("lon_idx"))}
    return df.agg(
        F.count(r).alias("n_cells"), F.avg(r).alias("mean_r"), F.median(r).alias("median_r"), F.count_if(F.abs(r) >= 0.3).alias("n_r03"), F.count_if(F.abs(r) >= 0.5).alias("n_r05"),
        F.count_if(strong).alias("n_strong"), F.try_divide(F.count_if(strong).cast("double"), F.count(r)).alias("share_strong"), F.count_if(strong & sig).alias("n_strong_significant"),
        *(f(c).alias(f"{k}_{n}") for k, c in place.items() for n, f in (("min", F.min), ("max", F.max), ("median", F.median))),
    )


def correlation_bands(df: DataFrame, grid: Grid = Grid(), width: int = 5) -> DataFrame:
    """``axis, band, n_strong, n_strong_significant``: cells from r 0.5 in each band of ``width`` degrees (its lower edge) of latitude and of longitude."""
    sig = F.col("significant") if "significant" in df.columns else F.lit(False)
    band = lambda axis, c: F.struct(F.lit(axis).alias("axis"), lat_band(c, width).alias("band"))
    both = F.array(band("lat", grid.lat_center("lat_idx")), band("lon", grid.lon_center("lon_idx")))
    rows = df.where(F.col("r") >= 0.5).select(sig.alias("_s"), F.explode(both).alias("b"))
    return rows.groupBy("b.axis", "b.band").agg(F.count("*").alias("n_strong"), F.count_if("_s").alias("n_strong_significant"))


def fit_scalers(df: DataFrame, features: Sequence[str], split: str = "train") -> DataFrame:
    """One row per feature that exists: mean, population spread, range (0 becomes 1), median, quartile range, rows; NULL ignored, ``split`` only."""
    names = [f for f in features if f in df.columns]
    rows = df.where(F.col("split") == split)
    quartiles = exact_quantiles(rows, {f: [0.25, 0.5, 0.75] for f in names})
    aggs = [a.alias(f"{n}{i}") for i, f in enumerate(names) for n, a in (("mean", F.avg(f)), ("std", F.stddev_pop(f)), ("min", F.min(f).cast("double")), ("max", F.max(f).cast("double")))]
    one = rows.agg(F.count("*").alias("n_train"), *aggs)
    or_one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    of = lambda x: F.lit(x).cast("double")
    out = [F.struct(
        F.lit(f).alias("feature"), F.col(f"mean{i}").alias("mean"), or_one(F.col(f"std{i}")).alias("std_pop"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
        or_one(F.col(f"max{i}") - F.col(f"min{i}")).alias("range"), of(quartiles[f][1]).alias("median"), or_one(of(quartiles[f][2]) - of(quartiles[f][0])).alias("iqr"),
    ) for i, f in enumerate(names)]
    return one.select(F.explode(F.array(*out)).alias("r"), "n_train").select("r.*", "n_train")


def apply_scalers(df: DataFrame, params: DataFrame, features: Sequence[str] | None = None, tag: str | None = "oco3_independent") -> DataFrame:
    """Add ``<f>_scaled_a`` (standard) and ``<f>_scaled_b`` (range); a feature that is absent gives NULL columns. ``tag`` becomes the split."""
    out = {}
    for p in params.collect():  # a row per feature
        for name, low, unit in (("a", p["mean"], p["std_pop"]), ("b", p["min"], p["range"])):
            known = p.feature in df.columns and unit is not None
            out[f"{p.feature}_scaled_{name}"] = (F.col(p.feature) - F.lit(low)) / F.lit(unit) if known else F.lit(None).cast("double")
    for f in features or ():
        for s in "ab":
            out.setdefault(f"{f}_scaled_{s}", F.lit(None).cast("double"))
    if tag:
        out["split"] = F.lit(tag)
    return df.withColumns(out)


def scaled_summary(df: DataFrame, value: str = "xco2_anomaly") -> DataFrame:
    """One row on an exported table: rows, cells, mean and sample spread of ``value``."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(*K).alias("n_cells"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """R², RMSE, correlation, means, bias and n over rows that have both."""
    a, b = F.col(y), F.col(yhat)
    rows = df.where(a.isNotNull() & b.isNotNull())
    sse, sst = F.sum((a - b) * (a - b)), F.var_pop(a) * F.count(a)
    return rows.groupBy(*by).agg(
        (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"), F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"), pearson(a, b).alias("r"),
        F.avg(a).alias("mean_obs"), F.avg(b).alias("mean_pred"), F.avg(b - a).alias("bias"), F.count("*").alias("n"),
    )


def daily_series(df: DataFrame, y: str = "true_xco2", yhat: str = "pred_xco2") -> DataFrame:
    return df.groupBy("date").agg(F.avg(y).alias("obs_mean"), F.stddev_samp(y).alias("obs_std"), F.avg(yhat).alias("pred_mean"), F.count("*").alias("n"))


def spatial_bias(df: DataFrame, keys: Sequence[str] = K, y: str = "true_xco2", yhat: str = "pred_xco2") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(y).alias("obs_mean"), F.avg(yhat).alias("pred_mean"), F.avg(F.col(yhat) - F.col(y)).alias("bias"), F.count("*").alias("n"))


def hotspots(df: DataFrame, boxes: dict[str, tuple[float, float, float, float]], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows inside closed boxes (lat, lat, lon, lon) with the first box's name as ``hotspot``."""
    out = F.lit(None).cast("string")
    for name, (a, b, c, d) in reversed(boxes.items()):
        out = F.when(F.col(lat).between(a, b) & F.col(lon).between(c, d), F.lit(name)).otherwise(out)
    return df.withColumn("hotspot", out).where("hotspot IS NOT NULL")


def moments(df: DataFrame, column: str, by: Sequence[str] = (), more_than: int = 0) -> DataFrame:
    """n, mean, population spread, population skewness and excess kurtosis; groups of more than ``more_than`` values."""
    x = F.col(column)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")).where(F.col("n") > more_than)


def histogram(df: DataFrame, column: str, bins: int = 200) -> DataFrame:
    """``bin`` (from 0), ``low``, ``n``, ``density``; equal bins from minimum to maximum, the maximum in the last."""
    x = F.col(column)
    low, high, n = df.agg(F.min(x).cast("double"), F.max(x).cast("double"), F.count(x)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, low double, n long, density double")
    width = (high - low) / bins or 1.0
    b = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    out = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return out.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), "n", (F.col("n") / F.lit(n * width)).alias("density"))


def density_2d(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """``bx, by, n, log10_n`` on equal bins of both ranges."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if r.x0 is None:
        return df.sparkSession.createDataFrame([], "bx int, by int, n long, log10_n double")
    place = lambda c, a, b: F.least(F.floor((F.col(c) - F.lit(float(a))) / F.lit((float(b) - float(a)) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(place(x, r.x0, r.x1).alias("bx"), place(y, r.y0, r.y1).alias("by")).agg(F.count("*").alias("n")).withColumn("log10_n", F.log10("n"))


def huber(y: Column, yhat: Column, delta: float = 0.5) -> Column:
    e = F.abs(y - yhat)
    return F.when(e < delta, 0.5 * e * e).otherwise(delta * e - 0.5 * delta * delta)


def weighted_huber(df: DataFrame, y: str, yhat: str, weight: str | None = None, delta: float = 0.5) -> DataFrame:
    loss = huber(F.col(y), F.col(yhat), delta)
    return df.agg(F.avg(loss * F.col(weight) if weight else loss).alias("huber"))


def hotspot_weight(df: DataFrame, column: str = "tropomi_no2", q: float = 0.9, weight: float = 5.0, split: str | None = "train") -> DataFrame:
    """Add ``weight``: ``weight`` from the quantile of the training rows on, else 1 (NULL: 1)."""
    rows = df.where(F.col("split") == split) if split else df
    (limit,) = exact_quantiles(rows, {column: [q]})[column]
    return df.withColumn("weight", F.lit(1.0) if limit is None else F.when(F.col(column) >= F.lit(limit), weight).otherwise(1.0))


def qq_points(df: DataFrame, column: str, n: int = 200) -> DataFrame:
    """``i, theoretical, ordered`` at ``n`` order-statistic medians, for a plot against the normal distribution.

    The sample's quantiles are the linear ones at the positions (i - 1) / (n - 1), so only the ``n`` of them leave the aggregation.
    """
    shares = [k / (n - 1) for k in range(n)] if n > 1 else [0.5]
    rows = grouped_quantiles(df, [], column, shares).select(F.posexplode("quantiles").alias("i", "ordered"))
    end = 0.5 ** (1.0 / n)
    p = F.when(F.col("i") == 0, 1 - end).when(F.col("i") == n - 1, end).otherwise((F.col("i") + 1 - 0.3175) / F.lit(n + 0.365))
    return rows.withColumn("theoretical", normal_quantile(p)).select("i", "theoretical", "ordered")


def qq_fit(points: DataFrame) -> DataFrame:
    return points.agg(F.regr_slope("ordered", "theoretical").alias("slope"), F.regr_intercept("ordered", "theoretical").alias("intercept"), F.regr_r2("ordered", "theoretical").alias("r2"))


def date_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("n_dates"), F.count_distinct(F.trunc("date", "MM")).alias("n_months"), F.count("*").alias("n_rows"))


def distinct_partials(df: DataFrame, number: Column, by: Sequence[str] = ("date",)) -> DataFrame:
    """``by, bucket, bits``: which values of ``number`` (a whole number from 0) occur in each part, as bitmaps of 32,768 values; NULL is left out. Kept by day, they are merged without the rows."""
    n = number.cast("long")
    rows = df.where(n.isNotNull()).select(*by, F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("_bit"))
    return rows.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def merged_distinct(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, n_distinct``: exact number of values in all the parts together."""
    merged = partials.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("_n"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_distinct"))


def distinct_sketches(df: DataFrame, value: str, by: Sequence[str] = ("date",), lg_k: int = 14) -> DataFrame:
    """``by, sketch``: which values of any type occur in each part, as HyperLogLog sketches of at most 2^``lg_k`` bytes; NULL is left out. For values that bitmaps would be too sparse for."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, n_distinct``: the approximate number of values in all the parts together; the relative standard error is about 1.04 / sqrt(2^lg_k), 0.8 % for 14."""
    return sketches.groupBy(*by).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch", True)), F.lit(0)).alias("n_distinct"))


def month_number(date: str = "date") -> Column:
    return F.year(date) * 12 + F.month(date) - 1

"""Row filters, outlier bounds, missing-value audit and imputation, yield of each step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gridobs.functions.columns import col
from gridobs.operators.quantiles import exact_quantiles, grouped_quantiles

#: Closed physical ranges, the core columns, and the largest aerosol depth.
PHYSICAL_BOUNDS = {"xco2": (395.0, 430.0), "tropomi_no2": (-50.0, 200.0), "era5_blh": (0.0, None)}
MAX_AOD = 0.7


def bbox_filter(df: DataFrame, lat: tuple[float, float] = (20.0, 50.0), lon: tuple[float, float] = (100.0, 150.0), lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Closed box on both axes."""
    return df.where(F.col(lat_col).between(*lat) & F.col(lon_col).between(*lon))


def no2_pixels(df: DataFrame, min_qa: float = 0.75, lat: tuple[float, float] = (20.0, 50.0), lon: tuple[float, float] = (100.0, 150.0)) -> DataFrame:
    """Pixels inside the box of good quality; column amount also in µmol. A missing variable becomes a NULL column."""
    amount = F.col("no2_tvcd") if "no2_tvcd" in df.columns else F.lit(None).cast("double")
    return bbox_filter(df, lat, lon, "lat", "lon").where(F.col("qa") >= min_qa).withColumn("no2_tvcd_umol", amount * 1e6)


def quality_filter(df: DataFrame, max_aod: float = MAX_AOD) -> DataFrame:
    """Good retrievals without snow; NULL aerosol depth passes. Each test only if its column exists."""
    tests = {"xco2_quality_flag": lambda c: c == 0, "ret_snow_flag": lambda c: c == 0, "ret_aod_total": lambda c: c.isNull() | (c <= max_aod)}
    found = [t(F.col(c)) for c, t in tests.items() if c in df.columns]
    return df.where(reduce(and_, found)) if found else df


def strict_optical_filter(df: DataFrame, aod: float = MAX_AOD) -> DataFrame:
    """Good retrievals of known, small aerosol depth (NULL fails)."""
    return df.where((F.col("xco2_quality_flag") == 0) & (F.col("ret_aod_total") <= aod))


def filter_comparison(df: DataFrame, aod: float = MAX_AOD, tighter: float = 0.5) -> DataFrame:
    """One row: rows in all, by flag, by flag and depth, the extra ones against the tighter depth, and shares in percent."""
    good = F.col("xco2_quality_flag") == 0
    n = F.count("*")
    flag, loose, tight = (F.count_if(c) for c in (good, good & (F.col("ret_aod_total") <= aod), good & (F.col("ret_aod_total") <= tighter)))
    return df.agg(
        n.alias("n_all"), flag.alias("n_flag"), loose.alias("n_flag_aod"), (loose - tight).alias("n_extra"),
        (F.lit(100.0) * F.try_divide(flag, n)).alias("pct_flag"), (F.lit(100.0) * F.try_divide(loose, n)).alias("pct_flag_aod"),
    )


def physical_filter(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Closed ranges; NULL passes. Columns that don't exist are skipped."""
    for c, (low, high) in (bounds or PHYSICAL_BOUNDS).items():
        if c in df.columns:
            inside = [F.col(c) >= low] * (low is not None) + [F.col(c) <= high] * (high is not None)
            df = df.where(F.col(c).isNull() | reduce(and_, inside))
    return df


def outlier_bounds(df: DataFrame, column: str, method: str = "sigma", factor: float = 3.0, by: str = "month", least: int = 10) -> DataFrame:
    """``by, low, high`` for each group with at least ``least`` values, pooled over years."""
    x = F.col(column)
    if method == "sigma":
        low, high = F.avg(x) - factor * F.stddev_samp(x), F.avg(x) + factor * F.stddev_samp(x)
    elif method == "log_sigma":
        y = F.log1p(F.when(x.isNotNull(), F.greatest(x, F.lit(-0.9))))
        low, high = F.expm1(F.avg(y) - factor * F.stddev_samp(y)), F.expm1(F.avg(y) + factor * F.stddev_samp(y))
    elif method == "iqr":
        found = grouped_quantiles(df, [by], column, [0.25, 0.75]).where(F.col("n") >= least)
        q1, q3 = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
        return found.select(by, (q1 - factor * (q3 - q1)).alias("_low"), (q3 + factor * (q3 - q1)).alias("_high"))
    else:
        raise ValueError(f"no outlier method {method!r}")
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(x).alias("_n"), low.alias("_low"), high.alias("_high")).where(F.col("_n") >= least).drop("_n")


def outlier_filter(df: DataFrame, column: str = "xco2", method: str = "sigma", factor: float = 3.0, by: str = "month", least: int = 10) -> DataFrame:
    """Rows inside their group's closed bounds; NULL values, NULL groups and small groups pass.

    The bounds are at most one row per calendar month, which is why they are broadcast; a window would use twelve tasks.
    """
    bounds = outlier_bounds(df, column, method, factor, by, least).withColumnRenamed(by, "_by")
    x = F.col(column)
    return df.join(F.broadcast(bounds), F.col(by) == F.col("_by"), "left").where(x.isNull() | F.col("_low").isNull() | x.between(F.col("_low"), F.col("_high"))).drop("_by", "_low", "_high")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[c for c in cols if c in df.columns])


def missing_audit(df: DataFrame) -> DataFrame:
    """``column, n_missing, pct_missing``, worst first; one pass over the rows."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(df.columns))))
    return counts.select("n", rows.alias("r")).select("r.column", "r.n_missing", (F.lit(100.0) * F.try_divide("r.n_missing", "n")).alias("pct_missing")).orderBy(F.desc("n_missing"), "column")


def medians(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> dict[str, float | None]:
    """Exact medians by default; with ``accuracy`` the approximate ones, whose state is bounded."""
    if not cols:
        return {}
    if not accuracy:
        return {c: m for c, (m,) in exact_quantiles(df, {c: [0.5] for c in cols}).items()}
    return df.agg(*(F.approx_percentile(c, 0.5, accuracy).alias(c) for c in cols)).first().asDict()


def handle_missing(df: DataFrame, core: Sequence[str], max_missing: float = 0.999, zero: Sequence[str] = ("population_density",), accuracy: int | None = None) -> DataFrame:
    """Drop columns that are nearly always missing and rows without a core value; fill the rest.

    ``zero`` columns get 0, other numeric columns the median of the surviving rows.
    """
    n_row = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in df.columns)).first()
    gone = [c for c in df.columns if n_row["_n"] and 1 - n_row[c] / n_row["_n"] >= max_missing]
    df = drop_missing(df.drop(*gone), core)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    fill: dict[str, float] = {c: 0 for c in zero if c in numeric}
    rest = [c for c in numeric if c not in fill and c not in core and n_row[c] < n_row["_n"]]
    fill |= {c: m for c, m in medians(df, rest, accuracy).items() if m is not None}
    return df.fillna(fill)


def missing_bias(df: DataFrame, core: Sequence[str], by: Sequence[str] = ("year", "month")) -> DataFrame:
    """Per group: rows dropped for a missing core value, rows kept, and mean and spread of their latitudes."""
    dropped = reduce(or_, (F.col(c).isNull() for c in core))
    lat = F.col("latitude")
    return df.groupBy(*by).agg(
        F.count_if(dropped).alias("n_dropped"), F.count_if(~dropped).alias("n_kept"),
        F.avg(F.when(dropped, lat)).alias("dropped_lat_mean"), F.stddev_samp(F.when(dropped, lat)).alias("dropped_lat_std"),
        F.avg(F.when(~dropped, lat)).alias("kept_lat_mean"), F.stddev_samp(F.when(~dropped, lat)).alias("kept_lat_std"),
    )


def column_profile(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """``column, min, max, mean, low, high, n_outside, pct_missing`` of every numeric column, in one pass: what it holds, the range it should keep to, and values out of it."""
    bounds = PHYSICAL_BOUNDS if bounds is None else bounds
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]

    def outside(c: str) -> Column:
        low, high = bounds.get(c, (None, None))
        return F.count_if((F.col(c) < F.lit(low) if low is not None else F.lit(False)) | (F.col(c) > F.lit(high) if high is not None else F.lit(False)))

    aggs = [a.alias(f"{n}{i}") for i, c in enumerate(numeric) for n, a in (("a", F.min(c).cast("double")), ("b", F.max(c).cast("double")), ("c", F.avg(c)), ("d", F.count(c)), ("e", outside(c)))]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"c{i}").alias("mean"),
            *(F.lit(x).cast("double").alias(n) for n, x in zip(("low", "high"), bounds.get(c, (None, None)))), F.col(f"e{i}").alias("n_outside"),
            (F.lit(100.0) * F.try_divide(F.col("n") - F.col(f"d{i}"), F.col("n"))).alias("pct_missing"),
        )
        for i, c in enumerate(numeric)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def yield_funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """``step, name, n_rows, pct`` after each of the cumulative conditions, in one pass; step 0 is the input."""
    passed, conditions = F.lit(True), []
    for _, c in steps:
        passed = passed & F.coalesce(c, F.lit(False))
        conditions.append(passed)
    one = df.agg(F.count("*").alias("n0"), *(F.count_if(c).alias(f"n{i + 1}") for i, c in enumerate(conditions)))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n_rows"), (F.lit(100.0) * F.try_divide(F.col(f"n{i}"), F.col("n0"))).alias("pct")) for i, name in enumerate(["input", *(n for n, _ in steps)])]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``name, present, n_rows, n_missing``: a row per required column, in one pass; NULL and NaN are missing, and all of a column that is absent."""
    kinds = dict(df.dtypes)
    known = {c: F.count(F.nanvl(c, F.lit(None)) if kinds[c] in ("float", "double") else F.col(f"`{c}`")) for c in required if c in kinds}
    one = df.agg(F.count("*").alias("_n"), *(v.alias(f"_{i}") for i, v in enumerate(known.values())))
    place = {c: i for i, c in enumerate(known)}
    rows = [F.struct(F.lit(c).alias("name"), F.lit(c in known).alias("present"), F.col("_n").alias("n_rows"), (F.col("_n") - (F.col(f"_{place[c]}") if c in place else 0)).alias("n_missing")) for c in required]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validate_table(df: DataFrame, required: Sequence[str], min_rows: int = 10, max_null_ratio: float = 0.99) -> list[str]:
    """What is wrong with a table: absent columns, too few rows, columns with too many missing values. Empty if fine."""
    rows = missing_counts(df, required).collect() if required else []
    n = rows[0].n_rows if rows else df.count()
    wrong = [f"no column {r.name}" for r in rows if not r.present]
    if n < min_rows:
        wrong.append(f"{n} rows, at least {min_rows} are needed")
    return wrong + [f"{r.name}: {r.n_missing / n:.1%} missing" for r in rows if r.present and n and r.n_missing / n > max_null_ratio]


def numeric_if_mostly(df: DataFrame, threshold: float = 0.9, cols: Sequence[str] | None = None) -> DataFrame:
    """String columns of which more than ``threshold`` of the rows are numbers become double; the rest of their values NULL."""
    names = [c for c, t in df.dtypes if t == "string" and (cols is None or c in cols)]
    if not names:
        return df
    share = df.agg(*(F.try_divide(F.count(F.expr(f"try_cast(`{c}` AS double)")), F.count("*")).alias(c) for c in names)).first()
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in names if (share[c] or 0) > threshold})


def positive_flux(df: DataFrame, flux: str = "fluxes") -> DataFrame:
    """Inside the box, a positive flux, nothing missing."""
    return bbox_filter(df, lat_col="lat", lon_col="lon").where(col(flux) > 0).dropna()

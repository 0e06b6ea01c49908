"""Grid cells, sensors and derived columns of soundings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridobs.functions.columns import LON_BINS, REGIONS, Grid, Region, at_least, lat_band, lat_band_label, lon_bin_label, parse_time, region_label

K = ["lat_idx", "lon_idx"]


def assign_grid(df: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Add ``lat_idx, lon_idx``; rows outside (the upper edges are outside), NULL and NaN are dropped, by a filter on the coordinates that a scan can take."""
    lat, lon = grid.cells("latitude", "longitude")
    return df.where(grid.inside("latitude", "longitude")).withColumns({"lat_idx": lat, "lon_idx": lon})


def cell_center(df: DataFrame, grid: Grid = Grid()) -> DataFrame:
    return df.withColumn("lat_center", grid.lat_center("lat_idx")).withColumn("lon_center", grid.lon_center("lon_idx"))


def cell_corner(df: DataFrame, grid: Grid = Grid()) -> DataFrame:
    return df.withColumn("lat_corner", grid.lat_corner("lat_idx")).withColumn("lon_corner", grid.lon_corner("lon_idx"))


def detect_satellite(df: DataFrame, names_only: bool = False) -> DataFrame:
    """Add ``satellite_id``: 0, 1, or -1 if unknown, by the first rule whose column exists.

    The satellite's name; the source file's name; the launch date of the second sensor with its operation mode. ``names_only`` leaves the last out.
    """

    def by_name(c: str):
        name = F.lower(F.col(c))
        return F.when(name.rlike("oco.?3"), 1).when(name.rlike("oco.?2"), 0).otherwise(-1)

    if "satellite" in df.columns:
        out = by_name("satellite")
    elif "file_source" in df.columns:
        out = by_name("file_source")
    elif "time" in df.columns and not names_only:
        mode = F.upper(F.col("snd_operation_mode").cast("string")) if "snd_operation_mode" in df.columns else F.lit("")
        out = F.when(F.col("time") < F.lit("2019-08-06").cast("timestamp"), 0).when(mode.contains("SAM") | (mode == "3"), 1).otherwise(-1)
    else:
        out = F.lit(-1)
    return df.withColumn("satellite_id", out.cast("int"))


def label_regions(df: DataFrame, regions: tuple[Region, ...] = REGIONS, default: str = "OUT", drop_outside: bool = False) -> DataFrame:
    df = df.withColumn("eaic_region", region_label("latitude", "longitude", regions, default))
    return df.where(F.col("eaic_region") != default) if drop_outside else df


def label_lon_bins(df: DataFrame, bins: tuple[tuple[str, float, float], ...] = LON_BINS, default: str = "Other") -> DataFrame:
    return df.withColumn("region", lon_bin_label("longitude", bins, default))


def with_lat_bands(df: DataFrame, width: int = 10) -> DataFrame:
    return df.withColumn("lat_band", lat_band("latitude", width)).withColumn("lat_band_str", lat_band_label("latitude", width))


def parse_times(df: DataFrame, date: str = "date") -> DataFrame:
    """The ``date`` string as a timestamp, rows that can't be read dropped, and ``date_key`` as YYYYMMDD; a numeric ``time`` is renamed ``tai_seconds``."""
    if dict(df.dtypes).get("time") in ("float", "double"):
        df = df.withColumnRenamed("time", "tai_seconds")
    df = df.withColumn(date, parse_time(F.col(date).cast("string"))).where(F.col(date).isNotNull())
    return df.withColumn("date_key", F.date_format(date, "yyyyMMdd"))


def calendar_cols(df: DataFrame, time: str = "date") -> DataFrame:
    """Add ``date, year, month, year_month`` (the month's first day)."""
    d = F.to_date(time)
    return df.withColumns({"date": d, "year": F.year(d), "month": F.month(d), "year_month": F.trunc(d, "MM")})


def dispersion_features(df: DataFrame, regions: tuple[str, ...] = tuple(r.name for r in REGIONS), region_col: str = "eaic_region") -> DataFrame:
    """Bounded wind and boundary layer (NULL stays NULL), one column of 0 or 1 per region, day of year and its circle."""
    doy = F.dayofyear("date")
    turn = F.lit(2 * math.pi) * doy / F.lit(365.25)
    return df.withColumns(
        {"WS_eff": at_least("era5_wind_speed", 0.1), "BLH_eff": at_least("era5_blh", 10.0), "doy": doy, "doy_sin": F.sin(turn), "doy_cos": F.cos(turn)}
        | {f"is_{r}": (F.col(region_col) == r).cast("int") for r in regions}
    )

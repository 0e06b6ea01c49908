"""Column expressions: missing values, grids, labels, calendar, file names, wind.

Missing is NULL everywhere (see ``null_if_missing``); functions keep NULL as NULL unless they say otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_missing(c: str | Column, fill: float | None = None, floating: bool = True) -> Column:
    """NULL for NaN and for the fill value; NaN in an average or a comparison would spoil it."""
    c = col(c)
    missing = F.isnan(c) if floating else F.lit(False)
    if fill is not None:
        missing = missing | (c == F.lit(fill))
    return F.when(missing, None).otherwise(c)


@dataclass(frozen=True)
class Grid:
    """A regular latitude/longitude grid, lower edges included and upper edges not."""

    lat_min: float = 20.0
    lat_max: float = 50.0
    lon_min: float = 100.0
    lon_max: float = 150.0
    res: float = 0.5

    @property
    def n_lat(self) -> int:
        return round((self.lat_max - self.lat_min) / self.res)

    @property
    def n_lon(self) -> int:
        return round((self.lon_max - self.lon_min) / self.res)

    def _inside(self, c: Column, low: float, n: int) -> Column:
        return within(c, low, low + n * self.res)

    def _cell(self, c: Column, low: float) -> Column:
        """Number of the cell of a value inside the grid."""
        i = F.floor((c - F.lit(low)) / F.lit(self.res))
        # with a step that is a power of two, or whole numbers, the quotient never rounds up to an edge; edges such as 20.1 aren't exact, so the neighbours are asked
        if not (math.frexp(self.res)[0] == 0.5 or (self.res == round(self.res) and low == round(low) and low >= 0)):
            i = i + (c >= F.lit(low) + (i + 1) * F.lit(self.res)).cast("int") - (c < F.lit(low) + i * F.lit(self.res)).cast("int")
        return i.cast("int")

    def inside(self, lat: str | Column, lon: str | Column) -> Column:
        """Whether a point is in the grid; not for NULL or NaN, which sorts above all numbers."""
        return self._inside(col(lat).cast("double"), self.lat_min, self.n_lat) & self._inside(col(lon).cast("double"), self.lon_min, self.n_lon)

    def _index(self, c: Column, low: float, n: int) -> Column:
        return F.when(self._inside(c, low, n), self._cell(c, low))

    def lat_idx(self, c: str | Column) -> Column:
        """Row of the cell; NULL outside the grid, for NULL and for NaN."""
        return self._index(col(c).cast("double"), self.lat_min, self.n_lat)

    def lon_idx(self, c: str | Column) -> Column:
        return self._index(col(c).cast("double"), self.lon_min, self.n_lon)

    def cells(self, lat: str | Column, lon: str | Column) -> tuple[Column, Column]:
        """Row and column of points that are inside."""
        return self._cell(col(lat).cast("double"), self.lat_min), self._cell(col(lon).cast("double"), self.lon_min)

    def lat_center(self, i: str | Column) -> Column:
        return F.lit(self.lat_min) + (col(i) + F.lit(0.5)) * F.lit(self.res)

    def lon_center(self, i: str | Column) -> Column:
        return F.lit(self.lon_min) + (col(i) + F.lit(0.5)) * F.lit(self.res)

    def lat_corner(self, i: str | Column) -> Column:
        return F.lit(self.lat_min) + col(i) * F.lit(self.res)

    def lon_corner(self, i: str | Column) -> Column:
        return F.lit(self.lon_min) + col(i) * F.lit(self.res)


@dataclass(frozen=True)
class Region:
    """A half-open box with the fewest distinct months of a valid cell and the fewest rows of a cell's year."""

    name: str
    lat: tuple[float, float]
    lon: tuple[float, float]
    min_months: int = 12
    min_rows: int = 6


# Boxes and thresholds of the five regions, and the four longitude bins.
REGIONS = (
    Region("NCP", (34.0, 41.0), (113.0, 122.0), 12, 6),
    Region("YRD", (28.5, 33.0), (118.0, 123.0), 12, 6),
    Region("PRD", (21.5, 24.5), (112.0, 115.5), 8, 4),
    Region("KCR", (35.0, 38.5), (125.0, 129.0), 6, 3),
    Region("JKT", (34.5, 37.0), (138.5, 141.0), 8, 4),
)
LON_BINS = (("West_China", 100.0, 115.0), ("East_China", 115.0, 128.0), ("Korea_Japan", 128.0, 145.0), ("Far_East", 145.0, 150.0))


def within(c: Column, low: float, high: float) -> Column:
    """Half-open interval."""
    return (c >= F.lit(low)) & (c < F.lit(high))


def region_label(lat: str | Column, lon: str | Column, regions: tuple[Region, ...] = REGIONS, default: str = "OUT") -> Column:
    """Name of the box that holds the point; the last of several, ``default`` for none."""
    out = F.lit(default)
    for r in regions:
        out = F.when(within(col(lat), *r.lat) & within(col(lon), *r.lon), F.lit(r.name)).otherwise(out)
    return out


def lon_bin_label(lon: str | Column, bins: tuple[tuple[str, float, float], ...] = LON_BINS, default: str = "Other") -> Column:
    out = F.lit(default)
    for name, low, high in reversed(bins):
        out = F.when(within(col(lon), low, high), F.lit(name)).otherwise(out)
    return out


def lat_band(lat: str | Column, width: int = 10) -> Column:
    return (F.floor(col(lat) / F.lit(width)) * width).cast("int")


def lat_band_label(lat: str | Column, width: int = 10) -> Column:
    b = lat_band(lat, width)
    return F.concat(b.cast("string"), F.lit("-"), (b + width).cast("string"), F.lit("°N"))


def lat_band_cut(lat: str | Column, edges: tuple[int, ...] = (20, 30, 40, 50)) -> Column:
    """Right-closed bands; NULL outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges[:-1], edges[1:]):
        out = F.when((col(lat) > a) & (col(lat) <= b), F.lit(f"({a}, {b}]")).otherwise(out)
    return out


def wind_speed(u: str | Column, v: str | Column) -> Column:
    return F.sqrt(col(u) * col(u) + col(v) * col(v))


def wind_direction(u: str | Column, v: str | Column) -> Column:
    """Degrees from 0 to below 360 of atan2(u, v)."""
    return (F.degrees(F.atan2(col(u), col(v))) + 360.0) % F.lit(360.0)


def at_least(c: str | Column, low: float) -> Column:
    """The larger of value and bound; NULL stays NULL, unlike ``greatest``."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(low)))


def parse_time(c: str | Column) -> Column:
    """Timestamp of a date string in the common layouts, without a trailing ``.0``; NULL if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col(c)), r"\.0+$", ""))


def date_vector_time(c: str | Column) -> Column:
    """Timestamp of an array of year, month, day, hour, minute, second (, microsecond, which is dropped)."""
    c = col(c)
    return F.try_make_timestamp(*(F.get(c, k) for k in range(6)))


def file_year(name: str | Column) -> Column:
    """Year from a ``_YYMMDD_`` token of a file name, ``unknown`` without one."""
    yy = F.regexp_extract(col(name), r"_(\d{2})\d{4}(?:_|\.)", 1)
    return F.when(yy == "", F.lit("unknown")).otherwise(F.concat(F.lit("20"), yy))


def granule_part(name: str | Column, part: str) -> Column:
    """``date``, ``time_start`` or ``time_end`` of a granule file name: ``YYYYMMDDTHHMMSS_YYYYMMDDTHHMMSS`` after the last ``____``."""
    times = F.element_at(F.split(col(name), "____"), -1)
    begin, n = {"date": (1, 8), "time_start": (1, 15), "time_end": (17, 15)}[part]
    return F.substring(times, begin, n)


def tile_name(row: Column, col: Column, tile: int, by: Sequence[str] = ()) -> Column:
    """Name of the tile of ``tile`` x ``tile`` pixels, one text for its ``by`` and place: a scan prunes partitions column by column, so one column is pruned exactly. NULL without a place."""
    place = [F.floor(c / F.lit(tile)).cast("string") for c in (row, col)]
    return F.when(row.isNotNull() & col.isNotNull(), F.concat_ws("_", *(F.col(b).cast("string") for b in by), *place))

"""Joins in space: nearest point of the same day, rasters, regular grids, overpass hours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridobs.functions.columns import tile_name, wind_direction, wind_speed
from gridobs.operators.tables import cut, with_rows_of


#: Points of a bucket that a point may be compared with one by one; points of a cell that is not divided any more.
DENSE, LEAF, FINEST = 256, 16, 8


def _distance2(y: str | Column, x: str | Column) -> Column:
    """Square of the distance in degrees from the asking point (``_y, _x``)."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (y, x))
    return (y - F.col("_y")) * (y - F.col("_y")) + (x - F.col("_x")) * (x - F.col("_x"))


def _levels(points: DataFrame, on: str, cell: float, grow: int, span: float) -> tuple[list[DataFrame], float]:
    """The pyramid of occupied cells and the size of its finest: a table a level, the coarsest first: ``on, _cy, _cx`` (cell), ``_py, _px`` (cell of the level above), and the box around its points.

    The finest cells hold ``LEAF`` points at most, unless points are nearer to each other than ``cell / grow ** FINEST``; the coarsest are ``LEAF`` a date at most, unless larger than ``span``.
    A level is made from the one below, so only the finest reads points.
    """
    size, deeper = cell, 0
    while True:
        finest = points.groupBy(on, F.floor(F.col("lat") / F.lit(size)).alias("_cy"), F.floor(F.col("lon") / F.lit(size)).alias("_cx")).agg(
            F.min("lat").alias("_south"), F.max("lat").alias("_north"), F.min("lon").alias("_west"), F.max("lon").alias("_east"), F.count("*").alias("_n"))
        finest = cut(finest)
        most = finest.agg(F.max("_n")).first()[0] or 0
        if most <= LEAF or deeper == FINEST:
            break
        size, deeper = size / grow, deeper + 1
    up = lambda c: F.floor(F.col(c) / F.lit(grow))
    levels, smallest = [finest], size
    while size < span:
        size *= grow
        above = levels[-1].groupBy(on, up("_cy").alias("_cy"), up("_cx").alias("_cx")).agg(
            F.min("_south").alias("_south"), F.max("_north").alias("_north"), F.min("_west").alias("_west"), F.max("_east").alias("_east"), F.sum("_n").alias("_n"))
        above = cut(above)
        cells, most = above.groupBy(on).agg(F.count("*").alias("c"), F.max("_n").alias("m")).agg(F.max("c"), F.max("m")).first()
        if most is not None and most <= LEAF:  # these are fine enough
            levels, smallest = [above], size
        else:
            levels.append(above)
        if cells is None or cells <= LEAF:
            break
    return [level.drop("_n").withColumn("_py", up("_cy")).withColumn("_px", up("_cx")) for level in reversed(levels)], smallest


def _nearest_cells(asked: DataFrame, levels: list[DataFrame], on: str, key: str) -> DataFrame:
    """``asked`` with the finest cells (``_cy, _cx``) that may hold its nearest point: from level to level only cells that begin nearer than some point of another surely lies.

    A box with a point on each side has one no farther than the nearer side of one axis at the farther end of the other.
    """
    y, x = F.col("_y"), F.col("_x")
    outside = lambda a, b, v: F.greatest(F.col(a) - v, v - F.col(b), F.lit(0.0))
    nearer = lambda a, b, v: F.when(v <= (F.col(a) + F.col(b)) / 2, F.col(a)).otherwise(F.col(b))
    farther = lambda a, b, v: F.when(F.abs(F.col(a) - v) >= F.abs(F.col(b) - v), F.col(a)).otherwise(F.col(b))
    sides = ("_south", "_north", y), ("_west", "_east", x)
    least = outside(*sides[0]) * outside(*sides[0]) + outside(*sides[1]) * outside(*sides[1])
    surely = F.least(_distance2(nearer(*sides[0]), farther(*sides[1])), _distance2(farther(*sides[0]), nearer(*sides[1])))
    found = asked
    for k, level in enumerate(levels):
        if k:
            found = found.withColumnsRenamed({"_cy": "_py", "_cx": "_px"}).join(level, [on, "_py", "_px"])
        else:
            found = found.join(level, on)  # the top: a cell or a few a date
        found = found.select(key, on, "_y", "_x", "_cy", "_cx", least.alias("_least"), surely.alias("_surely"))
        found = found.withColumn("_bound", F.min("_surely").over(Window.partitionBy(key))).where("_least <= _bound").select(key, on, "_y", "_x", "_cy", "_cx")
    return found


def nearest_join(left: DataFrame, right: DataFrame, values: Sequence[str], on: str = "date", key: str = "sounding_id", cell: float = 0.25, grow: int = 4, span: float = 360.0) -> DataFrame:
    """Each row of ``left`` with ``values`` of the point of ``right`` of the same date at the least distance in degrees, and ``distance``.

    As-of join in space by equi-joins. First each left point looks at its 3 x 3 buckets of ``cell`` degrees; an answer counts if it is nearer than the edge of that block.
    Where that finds nothing sure, or a bucket of more than ``DENSE`` points, a pyramid of occupied cells leads to the answer: from the largest cells of the date down to
    cells of a few points, keeping only those that can still hold the nearest. So the pairs of a left point stay few, wherever the points lie. Ties go to the smaller (lat, lon, values).
    Dates without points and NULL coordinates give NULL. ``key`` must be unique in ``left``; ``left`` has ``latitude, longitude``, ``right`` has ``lat, lon``.
    """
    have = [v for v in values if v in right.columns]
    points = right.dropna(subset=[on, "lat", "lon"]).where(~F.isnan("lat") & ~F.isnan("lon")).groupBy(on, "lat", "lon").agg(F.min(F.struct(*have) if have else F.lit(0)).alias("_v"))
    places = left.dropna(subset=[on, "latitude", "longitude"]).where(~F.isnan("latitude") & ~F.isnan("longitude")).select(key, on, F.col("latitude").alias("_y"), F.col("longitude").alias("_x"))
    points, places = cut(points), cut(places)
    size, near, bucket = F.lit(cell), F.array(F.lit(-1), F.lit(0), F.lit(1)), [on, "_by", "_bx"]
    by, bx = F.floor(F.col("_y") / size), F.floor(F.col("_x") / size)
    asked = places.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)).withColumn("_by", by + F.col("_dy")).withColumn("_bx", bx + F.col("_dx")).drop("_dy", "_dx")
    there = points.withColumn("_by", F.floor(F.col("lat") / size)).withColumn("_bx", F.floor(F.col("lon") / size))
    counts = there.groupBy(*bucket).agg(F.count("*").alias("_n"))
    few = there.join(counts.where(F.col("_n") <= DENSE), bucket).drop("_n")
    dense = counts.where(F.col("_n") > DENSE).drop("_n")  # a bucket of many points stands as one row without a place
    here = few.unionByName(dense, allowMissingColumns=True)
    answer = F.min(F.when(F.col("lat").isNotNull(), F.struct(_distance2("lat", "lon").alias("d2"), "lat", "lon", "_v")))
    best = asked.join(here, bucket).groupBy(key, on, "_y", "_x").agg(answer.alias("_best"), F.max(F.col("lat").isNull()).alias("_dense"))
    edge = F.least(F.col("_y") - (by - 1) * size, (by + 2) * size - F.col("_y"), F.col("_x") - (bx - 1) * size, (bx + 2) * size - F.col("_x"))
    found = cut(best.where(~F.col("_dense") & (F.sqrt("_best.d2") < edge)).select(F.col(key).alias("_key"), "_best"))
    todo = cut(places.join(found, F.col(key) == F.col("_key"), "left_anti").join(points.select(on).distinct(), on, "left_semi"))
    if todo.limit(1).count():
        levels, finest = _levels(points.join(todo.select(on).distinct(), on, "left_semi"), on, cell, grow, span)
        cells = _nearest_cells(todo, levels, on, key)
        there = points.withColumn("_cy", F.floor(F.col("lat") / F.lit(finest))).withColumn("_cx", F.floor(F.col("lon") / F.lit(finest)))
        rest = cells.join(there, [on, "_cy", "_cx"]).groupBy(key).agg(F.min(F.struct(_distance2("lat", "lon").alias("d2"), "lat", "lon", "_v")).alias("_best"))
        found = found.unionByName(cut(rest.select(F.col(key).alias("_key"), "_best")))
    out = found.select("_key", *(F.col(f"_best._v.{v}").alias(f"_v{i}") for i, v in enumerate(have)), F.sqrt("_best.d2").alias("distance"))
    joined = left.drop(*values, "distance").join(out, F.col(key) == F.col("_key"), "left")
    joined = joined.withColumns({v: F.col(f"_v{have.index(v)}") if v in have else F.lit(None).cast("double") for v in values})
    return joined.drop("_key", *(f"_v{i}" for i in range(len(have))))


def grid_join(left: DataFrame, right: DataFrame, values: Sequence[str], lat0: float, lon0: float, step: float, on: str = "date") -> DataFrame:
    """The same where ``right`` is a regular grid: round to the node (half down, as the smaller of two equally near) and equi-join."""
    node = lambda c, o: F.ceil((F.col(c) - F.lit(o)) / F.lit(step) - F.lit(0.5))
    grid = right.select(on, F.round((F.col("lat") - lat0) / step).cast("long").alias("_i"), F.round((F.col("lon") - lon0) / step).cast("long").alias("_j"), *values)
    return left.withColumn("_i", node("latitude", lat0)).withColumn("_j", node("longitude", lon0)).join(grid, [on, "_i", "_j"], "left").drop("_i", "_j")


@dataclass(frozen=True)
class Transform:
    """Upper left corner and pixel size of a raster whose rows go south."""

    lat_top: float = 50.0
    lon_left: float = 100.0
    step: float = 5.0


def sample_raster(df: DataFrame, raster: DataFrame, transform: Transform, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Value of the pixel that holds each point; with ``by`` (year, month) that of its month. No pixel or month: NULL."""
    row = F.floor((F.lit(transform.lat_top) - F.col("latitude")) / F.lit(transform.step)).alias("_row")
    column = F.floor((F.col("longitude") - F.lit(transform.lon_left)) / F.lit(transform.step)).alias("_col")
    pixels = raster.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col("value").alias("_value"))
    points = df.select("*", row, column)
    same = (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c"))
    for b in by:
        same = same & (points[b] == F.col(f"_{b}"))
    return points.join(pixels, same, "left").withColumn(out, F.col("_value")).drop("_row", "_col", "_r", "_c", "_value", *(f"_{b}" for b in by))


def sample_tiles(df: DataFrame, tiles: DataFrame, transform: Transform, out: str, tile: int = 1024, by: Sequence[str] = ("year", "month")) -> DataFrame:
    """The same from a table that ``io.write_raster_tiles`` wrote: of a raster of any size only the tiles of the months that points lie in are read.

    The touched tiles are found first, a row each; the scan of the raster prunes its partitions by them while it runs.
    """
    row = F.floor((F.lit(transform.lat_top) - F.col("latitude")) / F.lit(transform.step))
    column = F.floor((F.col("longitude") - F.lit(transform.lon_left)) / F.lit(transform.step))
    touched = df.select(tile_name(row, column, tile, by).alias("tile")).distinct()
    read = with_rows_of(tiles, cut(touched).where("tile > ''"), ["tile"], "left_semi")
    return sample_raster(df, read, transform, out, by)


def overpass_hours(granules: DataFrame) -> DataFrame:
    """``date, hour``: every whole hour from start to end of a distinct granule; none if the end's hour is before the start's."""
    h0, h1 = F.hour("time_start"), F.hour("time_end")
    hours = F.explode(F.when(h1 >= h0, F.sequence(h0, h1)))
    return granules.select("date", "time_start", "time_end").dropDuplicates().select("date", hours.alias("hour")).distinct()


def restrict_to_hours(weather: DataFrame, hours: DataFrame) -> DataFrame:
    return weather.join(hours, ["date", "hour"], "left_semi")


def _mean(c: str) -> Column:
    return F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None)))


def weather_daily(hourly: DataFrame) -> DataFrame:
    """Per date and point the means of wind and boundary layer over the day's hours (NULL and NaN ignored), and speed and direction of the mean vector; half-even rounding."""
    d = hourly.groupBy("date", "lat", "lon").agg(_mean("u10").alias("u"), _mean("v10").alias("v"), _mean("blh").alias("b"))
    return d.select(
        "date", F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"), F.bround("u", 6).alias("u10_daily"), F.bround("v", 6).alias("v10_daily"), F.bround("b", 4).alias("blh_daily"),
        F.bround(wind_speed("u", "v"), 4).alias("wind_speed_daily"), F.bround(wind_direction("u", "v"), 2).alias("wind_dir_deg_daily"),
    )


def weather_at_overpass(hourly: DataFrame, hours: DataFrame) -> DataFrame:
    """Instant values of the overpass hours beside the day's means; one exchange, as window and join share their keys."""
    day = Window.partitionBy("date", "lat", "lon")
    with_day = hourly.select("date", "hour", "lat", "lon", F.col("u10").alias("u10_obs"), F.col("v10").alias("v10_obs"), F.col("blh").alias("blh_obs"), *(_mean(c).over(day).alias(f"{c}_daily") for c in ("u10", "v10", "blh")))
    return restrict_to_hours(with_day, hours).withColumn("obs_time", F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")))


def compare_years(df: DataFrame, y0: int, y1: int, month: int = 1, flux: str = "fluxes") -> DataFrame:
    """``lat, lon`` of one month in both years, total flux of each."""
    side = lambda y, name: df.where((F.col("year") == y) & (F.col("month") == month)).groupBy("lat", "lon").agg(F.sum(flux).alias(name))
    return side(y0, f"{flux}_{y0}").join(side(y1, f"{flux}_{y1}"), ["lat", "lon"])


def reconstruct(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted and true concentration of observed cell-days: anomaly plus background."""
    keys = ["date", "lat_idx", "lon_idx"]
    rows = observed.select(*keys, "xco2_anomaly", "xco2_background").join(predicted.select(*keys, "pred_anomaly"), keys)
    return rows.select(*keys, (F.col("pred_anomaly") + F.col("xco2_background")).alias("pred_xco2"), (F.col("xco2_anomaly") + F.col("xco2_background")).alias("true_xco2"), F.col("xco2_background").alias("background"))

"""The registered queries of the observation operators, each beside the same in DuckDB SQL.

``@query(columns, sql)``: columns are named in order; ``~x`` is a double compared to 6 digits (``^x`` to 8, where the data have
ties at the seventh), ``#x`` a long, ``%x`` an int. Queries without SQL are
tested in tests/ only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridobs.functions import columns as C
from gridobs.operators import baseline, collocate, diagnose, equations, frames, grid, qc, split, stats, superobs
from gridobs.plans.views import cte, view
from gridobs.sources import io

Query = Callable[[SparkSession, str], DataFrame]
G5, G10, HALF = C.Grid(res=5.0), C.Grid(res=10.0), C.Grid(res=0.5)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    names = [(c[0], c[1:]) if c[0] in "~^#%" else ("", c) for c in columns.split()]

    def register(f: Query) -> Query:
        kinds = {"~": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "^": lambda c: F.round(c.cast("double"), 8) + F.lit(0.0), "#": lambda c: c.cast("long"), "%": lambda c: c.cast("int"), "": lambda c: c}
        QUERIES[f.__name__] = lambda spark, sf: f(spark, sf).select(*(kinds[k](F.col(n)).alias(n) for k, n in names))
        if sql:
            text = {k: t + ' AS "{n}"' for k, t in {"~": 'round(CAST("{n}" AS DOUBLE), 6) + 0e0', "^": 'round(CAST("{n}" AS DOUBLE), 8) + 0e0', "#": 'CAST("{n}" AS BIGINT)', "%": 'CAST("{n}" AS INTEGER)', "": '"{n}"'}.items()}
            SQL[f.__name__] = f"SELECT {', '.join(text[k].format(n=n) for k, n in names)} FROM ({sql}) AS q"
        return f

    return register


# The DuckDB side's chain of views.
_BOX = "latitude >= 20 AND latitude < 50 AND longitude >= 100 AND longitude < 150"
_S = cte("soundings") + f""",
s AS (SELECT *, CAST(floor((latitude - 20e0) / 5e0) AS INT) AS lat_idx, CAST(floor((longitude - 100e0) / 5e0) AS INT) AS lon_idx FROM v_soundings WHERE {_BOX})"""
_REGION = """CASE WHEN latitude >= 34.5e0 AND latitude < 37 AND longitude >= 138.5e0 AND longitude < 141 THEN 'JKT' WHEN latitude >= 35 AND latitude < 38.5e0 AND longitude >= 125 AND longitude < 129 THEN 'KCR'
 WHEN latitude >= 21.5e0 AND latitude < 24.5e0 AND longitude >= 112 AND longitude < 115.5e0 THEN 'PRD' WHEN latitude >= 28.5e0 AND latitude < 33 AND longitude >= 118 AND longitude < 123 THEN 'YRD'
 WHEN latitude >= 34 AND latitude < 41 AND longitude >= 113 AND longitude < 122 THEN 'NCP' ELSE 'OUT' END"""
_BIN = "CASE WHEN longitude >= 100 AND longitude < 115 THEN 'West_China' WHEN longitude >= 115 AND longitude < 128 THEN 'East_China' WHEN longitude >= 128 AND longitude < 145 THEN 'Korea_Japan' WHEN longitude >= 145 AND longitude < 150 THEN 'Far_East' ELSE 'Other' END"
_O = _S + f""",
o0 AS (SELECT date, lat_idx, lon_idx, median(xco2) AS xco2, median(tropomi_no2) AS tropomi_no2, avg(era5_u10) AS era5_u10, avg(era5_v10) AS era5_v10, avg(era5_blh) AS era5_blh, avg(latitude) AS latitude, avg(longitude) AS longitude,
  avg(population_density) AS population_density, avg(odiac_emission) AS odiac_emission, count(xco2) AS n_soundings FROM s WHERE xco2_quality_flag = 0 AND ret_aod_total <= 0.7e0 GROUP BY 1, 2, 3),
o AS (SELECT *, year(date) AS year, month(date) AS month, CAST(date_trunc('month', date) AS DATE) AS year_month, {_REGION} AS eaic_region, {_BIN} AS region, CAST(floor(latitude / 10) * 10 AS INT) AS lat_band FROM o0)"""
_A = _O + """,
cells AS (SELECT lat_idx, lon_idx FROM o GROUP BY 1, 2 HAVING count(DISTINCT year_month) >= 12),
v AS (SELECT o.* FROM o JOIN cells USING (lat_idx, lon_idx)),
clim AS (SELECT lat_idx, lon_idx, month, avg(xco2) AS clim FROM v GROUP BY 1, 2, 3),
alltime AS (SELECT lat_idx, lon_idx, avg(xco2) AS m FROM v GROUP BY 1, 2),
delta AS (SELECT y.lat_idx, y.lon_idx, y.year, y.m - t.m AS delta FROM (SELECT lat_idx, lon_idx, year, avg(xco2) AS m, count(xco2) AS n FROM v GROUP BY 1, 2, 3) y JOIN alltime t USING (lat_idx, lon_idx) WHERE y.n >= 5),
a AS (SELECT o.*, clim + delta AS xco2_baseline, xco2 - (clim + delta) AS xco2_anomaly FROM o JOIN clim USING (lat_idx, lon_idx, month) JOIN delta USING (lat_idx, lon_idx, year))"""
_T = _O + """,
rcells AS (SELECT DISTINCT lat_idx, lon_idx FROM (SELECT eaic_region, lat_idx, lon_idx, count(DISTINCT year_month) AS n FROM o GROUP BY 1, 2, 3) WHERE n >= CASE eaic_region WHEN 'PRD' THEN 8 WHEN 'KCR' THEN 6 WHEN 'JKT' THEN 8 ELSE 12 END),
rv AS (SELECT o.* FROM o JOIN rcells USING (lat_idx, lon_idx)),
gclim AS (SELECT lat_idx, lon_idx, month, avg(xco2) AS clim FROM rv GROUP BY 1, 2, 3),
rclim AS (SELECT eaic_region, month, avg(xco2) AS region_clim FROM o GROUP BY 1, 2),
aclim AS (SELECT month, avg(xco2) AS global_clim FROM o GROUP BY 1),
gdelta AS (SELECT y.lat_idx, y.lon_idx, y.year, y.m - t.m AS delta FROM (SELECT lat_idx, lon_idx, year, avg(xco2) AS m, count(xco2) AS n, max(CASE eaic_region WHEN 'NCP' THEN 6 WHEN 'YRD' THEN 6 WHEN 'PRD' THEN 4 WHEN 'KCR' THEN 3 WHEN 'JKT' THEN 4 ELSE 5 END) AS need FROM rv GROUP BY 1, 2, 3) y
  JOIN (SELECT lat_idx, lon_idx, avg(xco2) AS m FROM rv GROUP BY 1, 2) t USING (lat_idx, lon_idx) WHERE y.n >= need),
rdelta AS (SELECT y.eaic_region, y.year, y.m - t.m AS region_delta FROM (SELECT eaic_region, year, avg(xco2) AS m FROM o GROUP BY 1, 2) y JOIN (SELECT eaic_region, avg(xco2) AS m FROM o GROUP BY 1) t USING (eaic_region)),
t AS (SELECT o.*, coalesce(clim, region_clim, global_clim) + coalesce(delta, region_delta, 0e0) AS xco2_baseline, CASE WHEN clim IS NOT NULL THEN 10 WHEN region_clim IS NOT NULL THEN 20 WHEN global_clim IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN delta IS NOT NULL THEN 1 ELSE 2 END AS baseline_tier
  FROM o LEFT JOIN gclim USING (lat_idx, lon_idx, month) LEFT JOIN rclim USING (eaic_region, month) LEFT JOIN aclim USING (month) LEFT JOIN gdelta USING (lat_idx, lon_idx, year) LEFT JOIN rdelta USING (eaic_region, year))"""
_Z = _O + """,
z0 AS (SELECT date, lat_idx, quantile_cont(odiac_emission, 0.1) AS thr, min(odiac_emission) < max(odiac_emission) AS varied FROM o GROUP BY 1, 2),
z1 AS (SELECT date, lat_idx, CASE WHEN any_value(varied) AND count(*) FILTER (WHERE odiac_emission <= thr) >= 5 THEN median(xco2) FILTER (WHERE odiac_emission <= thr) ELSE median(xco2) END AS xco2_background FROM o JOIN z0 USING (date, lat_idx) GROUP BY 1, 2),
z AS (SELECT o.*, xco2_background, xco2 - xco2_background AS xco2_anomaly FROM o JOIN z1 USING (date, lat_idx))"""
_SPLIT = "CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'test' ELSE 'val' END"
_P = _Z + """,
p AS (SELECT date, lat_idx, lon_idx, latitude, longitude, tropomi_no2, xco2_anomaly * 0.75e0 + (lat_idx - lon_idx) * 0.125e0 + xco2_background AS pred_xco2, xco2_anomaly + xco2_background AS true_xco2, xco2_background AS background FROM z)"""


def soundings(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "soundings")


def cells_of(spark: SparkSession, sf: str) -> DataFrame:
    return grid.assign_grid(soundings(spark, sf), G5)


def supers(spark: SparkSession, sf: str) -> DataFrame:
    """Super-observations on 5 degrees with calendar, regions and bands: the stage that baselines read several times, so it is kept."""
    out = superobs.super_observation(qc.strict_optical_filter(cells_of(spark, sf)), with_error=False)
    return grid.with_lat_bands(grid.label_lon_bins(grid.label_regions(grid.calendar_cols(out)))).persist()


def strict(spark: SparkSession, sf: str) -> DataFrame:
    o = supers(spark, sf)
    cells = baseline.valid_cells(o)
    return baseline.apply_baseline(o, baseline.monthly_climatology(o, cells), baseline.yearly_deviation(o, cells))


def zonal(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.daily_zonal_background(supers(spark, sf))


def with_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.temporal_split(strict(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    obs = zonal(spark, sf)
    pred = obs.select("date", *grid.K, (F.col("xco2_anomaly") * 0.75 + (F.col("lat_idx") - F.col("lon_idx")) * 0.125).alias("pred_anomaly"))
    return collocate.reconstruct(obs, pred)


# --- projections and filters


@query("sounding_id %lat_idx %lon_idx ~lat_center ~lon_center ~lat_corner ~lon_corner", cte("soundings") + f"""
SELECT *, 20 + (lat_idx + 0.5e0) * 0.5e0 AS lat_center, 100 + (lon_idx + 0.5e0) * 0.5e0 AS lon_center, 20 + lat_idx * 0.5e0 AS lat_corner, 100 + lon_idx * 0.5e0 AS lon_corner FROM (
SELECT sounding_id, floor((latitude - 20e0) / 0.5e0) AS lat_idx, floor((longitude - 100e0) / 0.5e0) AS lon_idx FROM v_soundings WHERE {_BOX})""")
def grid_index(spark, sf):
    return grid.cell_corner(grid.cell_center(grid.assign_grid(soundings(spark, sf), HALF), HALF), HALF)


@query("sounding_id ~latitude ~longitude ~xco2 ~tropomi_no2", cte("soundings") + """
SELECT * FROM v_soundings WHERE latitude BETWEEN 20 AND 50 AND longitude BETWEEN 100 AND 150 AND xco2_quality_flag = 0 AND ret_snow_flag = 0 AND (ret_aod_total IS NULL OR ret_aod_total <= 0.7e0)
AND xco2 BETWEEN 395 AND 430 AND (tropomi_no2 IS NULL OR tropomi_no2 BETWEEN -50 AND 200) AND era5_blh >= 0""")
def bbox_qc(spark, sf):
    return qc.physical_filter(qc.quality_filter(qc.bbox_filter(soundings(spark, sf))))


@query("#n_all #n_flag #n_flag_aod #n_extra ~pct_flag ~pct_flag_aod", cte("soundings") + """
SELECT n_all, n_flag, n_flag_aod, n_flag_aod - n_tight AS n_extra, 100e0 * n_flag / n_all AS pct_flag, 100e0 * n_flag_aod / n_all AS pct_flag_aod FROM (
SELECT count(*) AS n_all, count(*) FILTER (WHERE xco2_quality_flag = 0) AS n_flag, count(*) FILTER (WHERE xco2_quality_flag = 0 AND ret_aod_total <= 0.7e0) AS n_flag_aod, count(*) FILTER (WHERE xco2_quality_flag = 0 AND ret_aod_total <= 0.5e0) AS n_tight FROM v_soundings)""")
def optical_filter_counts(spark, sf):
    return qc.filter_comparison(soundings(spark, sf))


@query("%satellite_id #n ~mean_xco2", cte("soundings") + """
SELECT CASE WHEN regexp_matches(lower(file_source), 'oco.?3') THEN 1 WHEN regexp_matches(lower(file_source), 'oco.?2') THEN 0 ELSE -1 END AS satellite_id, count(*) AS n, avg(xco2) AS mean_xco2 FROM v_soundings GROUP BY 1""")
def satellite_split(spark, sf):
    return grid.detect_satellite(soundings(spark, sf)).groupBy("satellite_id").agg(F.count("*").alias("n"), F.avg("xco2").alias("mean_xco2"))


_SENSOR = {
    "satellite": "CASE CAST(sounding_id % 5 AS INT) WHEN 0 THEN 'OCO-2' WHEN 1 THEN 'oco3' WHEN 2 THEN 'Orbiting OCO 3' WHEN 3 THEN 'GOSAT' END",
    "time": "CAST(date AS TIMESTAMP) + INTERVAL '24' YEAR",
    "snd_operation_mode": "CASE CAST(sounding_id % 5 AS INT) WHEN 0 THEN 'sam' WHEN 1 THEN 'ND' WHEN 2 THEN '3' WHEN 3 THEN '33' END",
}


@query("rule %satellite_id #n ~mean_xco2", cte("soundings") + f""", k AS (SELECT xco2, {", ".join(f'{e} AS {c}' for c, e in _SENSOR.items())} FROM v_soundings),
r AS (SELECT 'name' AS rule, CASE WHEN satellite IN ('oco3', 'Orbiting OCO 3') THEN 1 WHEN satellite = 'OCO-2' THEN 0 ELSE -1 END AS satellite_id, xco2 FROM k
UNION ALL SELECT 'launch', CASE WHEN time < TIMESTAMP '2019-08-06' THEN 0 WHEN snd_operation_mode IN ('sam', '3') THEN 1 ELSE -1 END, xco2 FROM k UNION ALL SELECT 'none', -1, xco2 FROM k)
SELECT rule, satellite_id, count(*) AS n, avg(xco2) AS mean_xco2 FROM r GROUP BY 1, 2""")
def satellite_rules(spark, sf):
    s = soundings(spark, sf).select("xco2", *(F.expr(e).alias(c) for c, e in _SENSOR.items()), F.lit("oco2.csv").alias("file_source"))
    by_rule = {"name": grid.detect_satellite(s), "launch": grid.detect_satellite(s.drop("satellite", "file_source")), "none": grid.detect_satellite(s.drop("satellite", "file_source"), names_only=True)}
    name, launch, none = (d.select(F.lit(rule).alias("rule"), "satellite_id", "xco2") for rule, d in by_rule.items())
    return name.unionByName(launch).unionByName(none).groupBy("rule", "satellite_id").agg(F.count("*").alias("n"), F.avg("xco2").alias("mean_xco2"))


_NEEDED = ("date", "xco2", "tropomi_no2", "ret_aod_total", "dp_abp")


@query("name present #n_rows #n_missing", cte("soundings") + """, k AS (SELECT count(*) AS n, count(date) AS date, count(xco2) AS xco2, count(tropomi_no2) AS tropomi_no2, count(ret_aod_total) AS ret_aod_total FROM v_soundings)
SELECT 'dp_abp' AS name, false AS present, n AS n_rows, n AS n_missing FROM k UNION ALL SELECT 'date', true, n, n - date FROM k UNION ALL SELECT 'xco2', true, n, n - xco2 FROM k
UNION ALL SELECT 'tropomi_no2', true, n, n - tropomi_no2 FROM k UNION ALL SELECT 'ret_aod_total', true, n, n - ret_aod_total FROM k""")
def missing_counts(spark, sf):
    return qc.missing_counts(soundings(spark, sf), _NEEDED)


@query("eaic_region #n", cte("soundings") + f"SELECT {_REGION} AS eaic_region, count(*) AS n FROM v_soundings GROUP BY 1")
def region_label(spark, sf):
    return grid.label_regions(soundings(spark, sf)).groupBy("eaic_region").agg(F.count("*").alias("n"))


@query("region #n", cte("soundings") + f"SELECT {_BIN} AS region, count(*) AS n FROM v_soundings GROUP BY 1")
def lon_bins(spark, sf):
    return grid.label_lon_bins(soundings(spark, sf)).groupBy("region").agg(F.count("*").alias("n"))


@query("lat_band_str band #n", cte("soundings") + """
SELECT CAST(CAST(floor(latitude / 10) * 10 AS INT) AS VARCHAR) || '-' || CAST(CAST(floor(latitude / 10) * 10 AS INT) + 10 AS VARCHAR) || '°N' AS lat_band_str,
CASE WHEN latitude > 20 AND latitude <= 30 THEN '(20, 30]' WHEN latitude > 30 AND latitude <= 40 THEN '(30, 40]' WHEN latitude > 40 AND latitude <= 50 THEN '(40, 50]' END AS band, count(*) AS n FROM v_soundings GROUP BY 1, 2""")
def lat_band_cut(spark, sf):
    return grid.with_lat_bands(soundings(spark, sf)).groupBy("lat_band_str", C.lat_band_cut("latitude").alias("band")).agg(F.count("*").alias("n"))


@query("sounding_id ~speed ~direction", cte("soundings") + "SELECT sounding_id, sqrt(era5_u10 * era5_u10 + era5_v10 * era5_v10) AS speed, fmod(degrees(atan2(era5_u10, era5_v10)) + 360, 360) AS direction FROM v_soundings")
def wind_speed_dir(spark, sf):
    return soundings(spark, sf).select("sounding_id", C.wind_speed("era5_u10", "era5_v10").alias("speed"), C.wind_direction("era5_u10", "era5_v10").alias("direction"))


@query("date %lat_idx %lon_idx ~WS_eff ~BLH_eff %doy ~doy_sin ~doy_cos %is_NCP %is_YRD %is_PRD %is_KCR %is_JKT", _O + """
SELECT *, greatest(sqrt(era5_u10 * era5_u10 + era5_v10 * era5_v10), 0.1e0) AS WS_eff, greatest(era5_blh, 10e0) AS BLH_eff, dayofyear(date) AS doy, sin(2 * pi() * dayofyear(date) / 365.25e0) AS doy_sin, cos(2 * pi() * dayofyear(date) / 365.25e0) AS doy_cos,
CAST(eaic_region = 'NCP' AS INT) AS is_NCP, CAST(eaic_region = 'YRD' AS INT) AS is_YRD, CAST(eaic_region = 'PRD' AS INT) AS is_PRD, CAST(eaic_region = 'KCR' AS INT) AS is_KCR, CAST(eaic_region = 'JKT' AS INT) AS is_JKT FROM o""")
def dispersion_features(spark, sf):
    return grid.dispersion_features(supers(spark, sf).withColumn("era5_wind_speed", C.wind_speed("era5_u10", "era5_v10")))


@query("pixel_id ~lat ~lon ~no2_tvcd_umol", cte("pixels") + "SELECT pixel_id, lat, lon, no2_tvcd_umol FROM v_pixels WHERE qa >= 0.75e0 AND lat BETWEEN 20 AND 50 AND lon BETWEEN 100 AND 150")
def no2_pixels(spark, sf):
    return qc.no2_pixels(view(spark, sf, "pixels").withColumn("no2_tvcd", F.col("no2_tvcd_umol") / 1e6))


@query("%month sector #n ~total", cte("inventory") + "SELECT month, sector, count(*) AS n, sum(fluxes) AS total FROM v_inventory WHERE fluxes > 0 AND lat BETWEEN 20 AND 50 AND lon BETWEEN 100 AND 150 GROUP BY 1, 2")
def positive_flux(spark, sf):
    return qc.positive_flux(view(spark, sf, "inventory")).groupBy("month", "sector").agg(F.count("*").alias("n"), F.sum("fluxes").alias("total"))


@query("event_id date date_key ~tai_seconds", """
SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS date, strftime(ts, '%Y%m%d') AS date_key, value AS tai_seconds FROM events WHERE event_id % 11 <> 0""")
def parsed_times(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.when(F.col("event_id") % 11 == 0, "no date").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".0")))
    return grid.parse_times(e.select("event_id", text.alias("date"), F.col("value").cast("double").alias("time")))


@query("sounding_id ~latitude ~longitude ~xco2 %ret_snow_flag ~tai_seconds file_kind", cte("soundings") + """
SELECT sounding_id, latitude, CASE WHEN sounding_id % 3 < 2 THEN longitude END AS longitude, CASE WHEN sounding_id % 3 < 2 THEN xco2 END AS xco2,
  CASE WHEN sounding_id % 3 = 2 THEN ret_snow_flag END AS ret_snow_flag, CASE WHEN sounding_id % 3 = 2 THEN CAST(sounding_id % 1000 AS DOUBLE) END AS tai_seconds, 'part' AS file_kind
FROM v_soundings""")
def read_by_header(spark, sf):
    """Soundings written as CSV files of three headers into one folder, and read again by header (A1, A2, G1)."""
    folder, rows = io.scratch_dir(spark), view(spark, sf, "soundings")
    headers = [["sounding_id", "latitude", "longitude", "xco2"], ["xco2", "odiac_emission", "longitude", "sounding_id", "latitude"], ["time", "latitude", "ret_snow_flag", "sounding_id"]]
    for k, names in enumerate(headers):
        some = rows.where(F.col("sounding_id") % 3 == k).withColumn("time", F.col("sounding_id") % 1000)
        some.select(*names).repartition(3).write.mode("append").option("header", True).csv(folder)
    return io.read_soundings(spark, [folder]).withColumn("file_kind", F.substring("file_source", 1, 4))


@query("event_id ~mostly rarely", """
SELECT event_id, CASE WHEN event_id % 20 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END AS mostly, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS rarely FROM events""")
def numeric_if_mostly(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    mostly = F.when(F.col("event_id") % 20 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rarely = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    return qc.numeric_if_mostly(e.select("event_id", mostly.alias("mostly"), rarely.alias("rarely")))


@query("event_id time granule_date file_year", """
SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS time, strftime(ts, '%Y%m%d') AS granule_date, '20' || strftime(ts, '%y') AS file_year FROM events""")
def parsed_names(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    name = F.concat(F.lit("S5P_L2____"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("_"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit(".nc"))
    v = F.array(*(f("ts").cast("int") for f in (F.year, F.month, F.day, F.hour, F.minute, F.second)))
    same = C.parse_time(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".0"))) == C.date_vector_time(v)
    time = F.when(same, C.date_vector_time(v)).cast("timestamp_ntz")
    return e.select("event_id", time.alias("time"), C.granule_part(name, "date").alias("granule_date"), C.file_year(F.concat(F.lit("oco2_"), F.date_format("ts", "yyMMdd"), F.lit("_x.nc4"))).alias("file_year"))


# --- super-observations


@query("date %lat_idx %lon_idx ~xco2 ^tropomi_no2 ~era5_u10 ~era5_v10 ~era5_blh ~latitude ~longitude ~population_density ~odiac_emission #n_soundings", _O + "SELECT * FROM o")
def super_obs(spark, sf):
    return supers(spark, sf)


@query("date %lat_idx %lon_idx ~xco2 #n_soundings ~xco2_bootstrap_std")
def super_obs_se(spark, sf):
    return superobs.super_observation(qc.strict_optical_filter(cells_of(spark, sf)))


@query("mode surface #n glint_over_land", cte("soundings") + """
SELECT mode, surface, count(*) AS n, mode = 'Glint' AND surface = 'Land' AS glint_over_land FROM (
SELECT CASE snd_operation_mode WHEN 0 THEN 'Nadir' WHEN 1 THEN 'Glint' ELSE 'Target' END AS mode, CASE snd_land_water_indicator WHEN 0 THEN 'Land' WHEN 1 THEN 'Ocean' ELSE 'Coast' END AS surface FROM v_soundings) GROUP BY 1, 2""")
def mode_land_counts(spark, sf):
    return superobs.mode_land_counts(soundings(spark, sf))


@query("%lat_idx %lon_idx #n_soundings ~log10_n", _O + "SELECT lat_idx, lon_idx, sum(n_soundings) AS n_soundings, log10(sum(n_soundings)) AS log10_n FROM o GROUP BY 1, 2")
def density_map(spark, sf):
    return superobs.observation_density(supers(spark, sf))


@query("sensor #n_rows #n_cells #n_soundings ~pct_rows ~pct_soundings", _S + """,
b AS (SELECT CASE WHEN contains(file_source, 'oco3') THEN 'OCO-3' ELSE 'OCO-2' END AS sensor, date, lat_idx, lon_idx, count(xco2) AS n FROM s WHERE xco2_quality_flag = 0 AND ret_aod_total <= 0.7e0 AND file_source <> 'other.csv' GROUP BY 1, 2, 3, 4),
c AS (SELECT sensor, count(*) AS n_rows, count(DISTINCT lat_idx * 1000 + lon_idx) AS n_cells, sum(n) AS n_soundings FROM b GROUP BY 1)
SELECT c.*, 100e0 * c.n_rows / x.n_rows AS pct_rows, 100e0 * c.n_soundings / x.n_soundings AS pct_soundings FROM c, (SELECT * FROM c WHERE sensor = 'OCO-2') x""")
def sensor_comparison(spark, sf):
    both = superobs.super_observation(grid.detect_satellite(qc.strict_optical_filter(cells_of(spark, sf))), by=["satellite_id"], with_error=False)
    return superobs.sensor_comparison(both.where("satellite_id = 0"), both.where("satellite_id = 1"))


# --- baselines


@query("%lat_idx %lon_idx", _A + "SELECT * FROM cells")
def valid_cells(spark, sf):
    return baseline.valid_cells(supers(spark, sf))


@query("%lat_idx %lon_idx %month ~clim", _A + "SELECT * FROM clim")
def monthly_climatology(spark, sf):
    o = supers(spark, sf)
    return baseline.monthly_climatology(o, baseline.valid_cells(o))


@query("%lat_idx %lon_idx %year ~delta", _A + "SELECT * FROM delta")
def yearly_deviation(spark, sf):
    o = supers(spark, sf)
    return baseline.yearly_deviation(o, baseline.valid_cells(o))


@query("date %lat_idx %lon_idx ~xco2 ~xco2_baseline ~xco2_anomaly", _A + "SELECT * FROM a")
def anomaly_strict(spark, sf):
    return strict(spark, sf)


@query("date %lat_idx %lon_idx ~xco2_anomaly", _S + """,
both0 AS (SELECT CASE WHEN contains(file_source, 'oco3') THEN 1 ELSE 0 END AS sat, date, lat_idx, lon_idx, median(xco2) AS xco2, year(date) AS year, month(date) AS month FROM s WHERE file_source <> 'other.csv' GROUP BY 1, 2, 3, 4),
b AS (SELECT *, date_trunc('month', date) AS ym FROM both0 WHERE sat = 0), ok AS (SELECT lat_idx, lon_idx FROM b GROUP BY 1, 2 HAVING count(DISTINCT ym) >= 12),
w AS (SELECT b.* FROM b JOIN ok USING (lat_idx, lon_idx)), c AS (SELECT lat_idx, lon_idx, month, avg(xco2) AS clim FROM w GROUP BY 1, 2, 3),
d AS (SELECT y.lat_idx, y.lon_idx, y.year, y.m - t.m AS delta FROM (SELECT lat_idx, lon_idx, year, avg(xco2) AS m, count(*) AS n FROM w GROUP BY 1, 2, 3) y JOIN (SELECT lat_idx, lon_idx, avg(xco2) AS m FROM w GROUP BY 1, 2) t USING (lat_idx, lon_idx) WHERE y.n >= 5)
SELECT date, lat_idx, lon_idx, xco2 - clim - delta AS xco2_anomaly FROM both0 JOIN c USING (lat_idx, lon_idx, month) JOIN d USING (lat_idx, lon_idx, year) WHERE sat = 1""")
def anomaly_cross_sensor(spark, sf):
    both = superobs.super_observation(grid.detect_satellite(cells_of(spark, sf)), by=["satellite_id"], with_error=False)
    both = grid.calendar_cols(both)
    first = both.where("satellite_id = 0")
    cells = baseline.valid_cells(first)
    return baseline.apply_baseline(both.where("satellite_id = 1"), baseline.monthly_climatology(first, cells), baseline.yearly_deviation(first, cells))


@query("date %lat_idx %lon_idx eaic_region ~xco2_baseline ~xco2_anomaly %baseline_tier", _T + "SELECT *, xco2 - xco2_baseline AS xco2_anomaly FROM t WHERE xco2 - xco2_baseline IS NOT NULL")
def anomaly_tiered(spark, sf):
    return baseline.tiered_anomaly(supers(spark, sf))


@query("%baseline_tier #n ~pct", _T + "SELECT baseline_tier, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER () AS pct FROM t WHERE xco2 - xco2_baseline IS NOT NULL GROUP BY 1")
def tier_distribution(spark, sf):
    return baseline.tier_distribution(baseline.tiered_anomaly(supers(spark, sf)))


# A sensor that misses months, years and cells, so that every tier is needed for the rows of the other.
_SPARSE = """NOT (eaic_region IN ('NCP', 'JKT') AND month <= 3) AND NOT (eaic_region = 'KCR' AND year = 2000) AND year <> 2001 AND NOT (month = 12 AND lat_idx >= 2)
 AND ((lat_idx + lon_idx) % 3 <> 0 OR month = 5) AND NOT (year = 1996 AND (lat_idx * 3 + lon_idx) % 4 = 0)"""
_TB = _O + f",\nob AS (SELECT * FROM o WHERE {_SPARSE})" + (lambda lookups, applied: re.sub(r"\bo\b", "ob", lookups) + "\nt AS (" + applied)(*_T[len(_O):].split("\nt AS ("))


def _sparse_tiers(spark, sf, with_tier):
    rows = supers(spark, sf)
    return baseline.tiered_anomaly(rows.where(_SPARSE), apply_to=rows, with_tier=with_tier)


@query("date %lat_idx %lon_idx eaic_region ~xco2_baseline ~xco2_anomaly", _TB + "SELECT *, xco2 - xco2_baseline AS xco2_anomaly FROM t WHERE xco2 - xco2_baseline IS NOT NULL")
def tiered_cross_sensor(spark, sf):
    return _sparse_tiers(spark, sf, None)


@query("%baseline_tier eaic_region #n ~mean_baseline", _TB + "SELECT baseline_tier, eaic_region, count(*) AS n, avg(xco2_baseline) AS mean_baseline FROM t WHERE xco2 - xco2_baseline IS NOT NULL GROUP BY 1, 2")
def tiers_of_a_sparse_sensor(spark, sf):
    return _sparse_tiers(spark, sf, True).groupBy("baseline_tier", "eaic_region").agg(F.count("*").alias("n"), F.avg("xco2_baseline").alias("mean_baseline"))


@query("date %lat_idx %lon_idx ~xco2_background ~xco2_anomaly", _Z + "SELECT * FROM z")
def zonal_background(spark, sf):
    return zonal(spark, sf)


@query("%year ~b20 ~b30 ~b40", _Z + "SELECT year, round(avg(xco2_anomaly) FILTER (WHERE lat_band = 20), 3) AS b20, round(avg(xco2_anomaly) FILTER (WHERE lat_band = 30), 3) AS b30, round(avg(xco2_anomaly) FILTER (WHERE lat_band = 40), 3) AS b40 FROM z GROUP BY 1")
def residual_trend(spark, sf):
    return baseline.residual_trend(zonal(spark, sf), "lat_band", [20, 30, 40]).withColumnsRenamed({"20": "b20", "30": "b30", "40": "b40"})


@query("~mean_anomaly near_zero", _A + "SELECT avg(xco2_anomaly) AS mean_anomaly, abs(avg(xco2_anomaly)) < 0.5e0 AS near_zero FROM a")
def residual_check(spark, sf):
    return baseline.residual_check(strict(spark, sf))


@query("%year %month %lat_idx %lon_idx ~xco2_anomaly ~xco2 ~xco2_baseline", _A + "SELECT year, month, lat_idx, lon_idx, avg(xco2_anomaly) AS xco2_anomaly, avg(xco2) AS xco2, avg(xco2_baseline) AS xco2_baseline FROM a GROUP BY 1, 2, 3, 4")
def monthly_cube(spark, sf):
    return baseline.monthly_cube(strict(spark, sf))


# --- quality control

_M = cte("soundings") + ", m AS (SELECT *, month(date) AS month FROM v_soundings)"


def _outlier_sql(column: str, low: str, high: str) -> str:
    return _M + f""", b AS (SELECT month, {low} AS lo, {high} AS hi, count({column}) AS n FROM m GROUP BY 1)
SELECT m.month, count(*) AS n, sum({column}) AS total FROM m LEFT JOIN b ON m.month = b.month AND b.n >= 10 WHERE {column} IS NULL OR lo IS NULL OR {column} BETWEEN lo AND hi GROUP BY 1"""


def _outliers(spark, sf, column, method, factor):
    rows = soundings(spark, sf).withColumn("month", F.month("date"))
    return qc.outlier_filter(rows, column, method, factor).groupBy("month").agg(F.count("*").alias("n"), F.sum(column).alias("total"))


@query("%month #n ~total", _outlier_sql("xco2", "avg(xco2) - 1.5e0 * stddev_samp(xco2)", "avg(xco2) + 1.5e0 * stddev_samp(xco2)"))
def outlier_sigma(spark, sf):
    return _outliers(spark, sf, "xco2", "sigma", 1.5)


_LN = "ln(1 + greatest(tropomi_no2, -0.9e0))"


@query("%month #n ~total", _outlier_sql("tropomi_no2", f"exp(avg({_LN}) - 1.1e0 * stddev_samp({_LN})) - 1", f"exp(avg({_LN}) + 1.1e0 * stddev_samp({_LN})) - 1").replace("greatest(tropomi_no2, -0.9e0)", "CASE WHEN tropomi_no2 IS NOT NULL THEN greatest(tropomi_no2, -0.9e0) END"))
def outlier_log_sigma(spark, sf):
    return _outliers(spark, sf, "tropomi_no2", "log_sigma", 1.1)


_Q1, _Q3 = "quantile_cont(tropomi_no2, 0.25)", "quantile_cont(tropomi_no2, 0.75)"


@query("%month #n ~total", _outlier_sql("tropomi_no2", f"{_Q1} - 0.3e0 * ({_Q3} - {_Q1})", f"{_Q3} + 0.3e0 * ({_Q3} - {_Q1})"))
def outlier_iqr(spark, sf):
    return _outliers(spark, sf, "tropomi_no2", "iqr", 0.3)


@query("column #n_missing ~pct_missing", cte("soundings") + """, n AS (SELECT count(*) AS n, count(*) - count(tropomi_no2) AS a, count(*) - count(ret_aod_total) AS b, count(*) - count(xco2) AS c FROM v_soundings)
SELECT 'tropomi_no2' AS "column", a AS n_missing, 100e0 * a / n AS pct_missing FROM n UNION ALL SELECT 'ret_aod_total', b, 100e0 * b / n FROM n UNION ALL SELECT 'xco2', c, 100e0 * c / n FROM n""")
def missing_audit(spark, sf):
    return qc.missing_audit(soundings(spark, sf).select("xco2", "tropomi_no2", "ret_aod_total"))


@query("sounding_id ~xco2 ~tropomi_no2 ~ret_aod_total ~population_density", cte("soundings") + """, k AS (SELECT sounding_id, xco2, tropomi_no2, ret_aod_total, CASE WHEN population_density > 0 THEN population_density END AS population_density FROM v_soundings WHERE tropomi_no2 IS NOT NULL)
SELECT sounding_id, xco2, tropomi_no2, coalesce(ret_aod_total, (SELECT median(ret_aod_total) FROM k)) AS ret_aod_total, coalesce(population_density, 0) AS population_density FROM k""")
def impute(spark, sf):
    rows = soundings(spark, sf).select("sounding_id", "xco2", "tropomi_no2", "ret_aod_total", "population_density", F.lit(None).cast("double").alias("empty"))
    return qc.handle_missing(io.normalize_missing(rows), ["xco2", "tropomi_no2"])


@query("%year %month #n_dropped #n_kept ~dropped_lat_mean ~dropped_lat_std ~kept_lat_mean ~kept_lat_std", cte("soundings") + """
SELECT year(date) AS year, month(date) AS month, count(*) FILTER (WHERE d) AS n_dropped, count(*) FILTER (WHERE NOT d) AS n_kept, avg(latitude) FILTER (WHERE d) AS dropped_lat_mean, stddev_samp(latitude) FILTER (WHERE d) AS dropped_lat_std,
avg(latitude) FILTER (WHERE NOT d) AS kept_lat_mean, stddev_samp(latitude) FILTER (WHERE NOT d) AS kept_lat_std FROM (SELECT *, tropomi_no2 IS NULL AS d FROM v_soundings) GROUP BY 1, 2""")
def missing_bias(spark, sf):
    return qc.missing_bias(grid.calendar_cols(soundings(spark, sf)), ["xco2", "tropomi_no2"])


@query("column ~min ~max ~mean ~low ~high #n_outside ~pct_missing", cte("soundings") + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min({c}) AS min, max({c}) AS max, avg({c}) AS mean, {lo} AS low, {hi} AS high, count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_outside, 100e0 * (count(*) - count({c})) / count(*) AS pct_missing FROM v_soundings""" for c, lo, hi in (("xco2", 395, 430), ("tropomi_no2", -50, 200), ("era5_blh", 0, "NULL"))))
def column_profile(spark, sf):
    return qc.column_profile(soundings(spark, sf).select("xco2", "tropomi_no2", "era5_blh"))


@query("%step name #n_rows ~pct", cte("soundings") + """, f AS (SELECT count(*) AS n0, count(*) FILTER (WHERE latitude BETWEEN 20 AND 50 AND longitude BETWEEN 100 AND 150) AS n1, count(*) FILTER (WHERE latitude BETWEEN 20 AND 50 AND longitude BETWEEN 100 AND 150 AND xco2_quality_flag = 0) AS n2,
count(*) FILTER (WHERE latitude BETWEEN 20 AND 50 AND longitude BETWEEN 100 AND 150 AND xco2_quality_flag = 0 AND xco2 BETWEEN 395 AND 430) AS n3 FROM v_soundings)
SELECT 0 AS step, 'input' AS name, n0 AS n_rows, 100e0 AS pct FROM f UNION ALL SELECT 1, 'box', n1, 100e0 * n1 / n0 FROM f UNION ALL SELECT 2, 'flag', n2, 100e0 * n2 / n0 FROM f UNION ALL SELECT 3, 'physical', n3, 100e0 * n3 / n0 FROM f""")
def yield_funnel(spark, sf):
    return qc.yield_funnel(soundings(spark, sf), [("box", F.col("latitude").between(20, 50) & F.col("longitude").between(100, 150)), ("flag", F.col("xco2_quality_flag") == 0), ("physical", F.col("xco2").between(395, 430))])


# --- statistics

_R = """SELECT lat_idx, lon_idx, count(*) AS n, count(tropomi_no2) AS n_valid, CASE WHEN count(tropomi_no2) >= 10 THEN corr(tropomi_no2, xco2_anomaly) END AS r FROM z GROUP BY 1, 2 HAVING count(*) >= 10"""


@query("%lat_idx %lon_idx #n #n_valid ~r", _Z + _R)
def cell_correlation(spark, sf):
    return stats.cell_correlation(zonal(spark, sf), with_p=False)


@query("%lat_idx %lon_idx #n_valid ~r ~p")
def cell_pvalue(spark, sf):
    return stats.cell_correlation(zonal(spark, sf))


@query("event_id significant", """, """.join(["""WITH p AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL WHEN event_id % 7 = 0 THEN value / 4e6 ELSE value / 500e0 END AS p FROM events)""",
"""k AS (SELECT count(*) AS m FROM p)""", """h AS (SELECT sum(1e0 / i) AS h FROM (SELECT unnest(range(1, (SELECT m + 1 FROM k))) AS i))""",
"""r AS (SELECT p, row_number() OVER (ORDER BY p) AS rank FROM p WHERE p IS NOT NULL)""", """c AS (SELECT max(r.p) AS c FROM r, k, h WHERE r.p <= rank / CAST(m AS DOUBLE) * (0.05e0 / h))"""]) + " SELECT event_id, coalesce(p <= c, false) AS significant FROM p, c")
def fdr_by(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    p = F.when(F.col("user_id") % 10 == 0, None).when(F.col("event_id") % 7 == 0, F.col("value") / F.lit(4e6)).otherwise(F.col("value") / F.lit(500.0))
    return stats.fdr_by(e.select("event_id", p.alias("p")))


_STRONG = f"""SELECT *, CASE WHEN r >= 0.5e0 THEN 20 + (lat_idx + 0.5e0) * 5 END AS lat, CASE WHEN r >= 0.5e0 THEN 100 + (lon_idx + 0.5e0) * 5 END AS lon FROM ({_R})"""


@query("#n_cells ~mean_r ~median_r #n_r03 #n_r05 #n_strong ~share_strong #n_strong_significant ~lat_min ~lat_max ~lat_median ~lon_min ~lon_max ~lon_median", _Z + f"""
SELECT count(r) AS n_cells, avg(r) AS mean_r, median(r) AS median_r, count(*) FILTER (WHERE abs(r) >= 0.3e0) AS n_r03, count(*) FILTER (WHERE abs(r) >= 0.5e0) AS n_r05, count(lat) AS n_strong,
CASE WHEN count(r) > 0 THEN count(lat) / CAST(count(r) AS DOUBLE) END AS share_strong, count(*) FILTER (WHERE lat IS NOT NULL AND n_valid % 2 = 0) AS n_strong_significant,
min(lat) AS lat_min, max(lat) AS lat_max, median(lat) AS lat_median, min(lon) AS lon_min, max(lon) AS lon_max, median(lon) AS lon_median FROM ({_STRONG})""")
def correlation_summary(spark, sf):
    cells = stats.cell_correlation(zonal(spark, sf), with_p=False).withColumn("significant", F.col("n_valid") % 2 == 0)
    return stats.correlation_summary(cells, G5)


@query("axis %band #n_strong #n_strong_significant", _Z + f""", k AS (SELECT * FROM ({_STRONG}) WHERE lat IS NOT NULL)
SELECT axis, CAST(floor(place / 5) * 5 AS INT) AS band, count(*) AS n_strong, count(*) FILTER (WHERE n_valid % 2 = 0) AS n_strong_significant FROM (SELECT 'lat' AS axis, lat AS place, n_valid FROM k UNION ALL SELECT 'lon', lon, n_valid FROM k) GROUP BY 1, 2""")
def correlation_bands(spark, sf):
    cells = stats.cell_correlation(zonal(spark, sf), with_p=False).withColumn("significant", F.col("n_valid") % 2 == 0)
    return stats.correlation_bands(cells, G5)


@query("feature ~mean ~std_pop ~min ~max ~range ~median ~iqr #n_train", _Z + f", tr AS (SELECT * FROM z WHERE {_SPLIT} = 'train') " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std_pop, min({c}) AS min, max({c}) AS max, max({c}) - min({c}) AS range, median({c}) AS median, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, count(*) AS n_train FROM tr" for c in ("tropomi_no2", "era5_blh", "odiac_emission")))
def scalers(spark, sf):
    return stats.fit_scalers(split.temporal_split(zonal(spark, sf)), ["tropomi_no2", "era5_blh", "odiac_emission", "absent"])


@query("date %lat_idx %lon_idx ~tropomi_no2_scaled_a ~tropomi_no2_scaled_b ~absent_scaled_a split", _Z + f"""
SELECT date, lat_idx, lon_idx, (tropomi_no2 - m) / s AS tropomi_no2_scaled_a, (tropomi_no2 - lo) / (hi - lo) AS tropomi_no2_scaled_b, CAST(NULL AS DOUBLE) AS absent_scaled_a, 'oco3_independent' AS split
FROM z, (SELECT avg(tropomi_no2) AS m, stddev_pop(tropomi_no2) AS s, min(tropomi_no2) AS lo, max(tropomi_no2) AS hi FROM z WHERE {_SPLIT} = 'train')""")
def scaled_export(spark, sf):
    z = split.temporal_split(zonal(spark, sf))
    return stats.apply_scalers(z, stats.fit_scalers(z, ["tropomi_no2"]), ["tropomi_no2", "absent"])


@query("#n_rows #n_cells ~mean ~std", _Z + "SELECT count(*) AS n_rows, count(DISTINCT (lat_idx, lon_idx)) AS n_cells, avg(xco2_anomaly) AS mean, stddev_samp(xco2_anomaly) AS std FROM z")
def scaled_summary(spark, sf):
    return stats.scaled_summary(zonal(spark, sf))


@query("^tropomi_no2 ~era5_blh ~xco2_anomaly", _Z + f", tr AS (SELECT * FROM z WHERE {_SPLIT} = 'train') SELECT coalesce(tropomi_no2, (SELECT median(tropomi_no2) FROM tr)) AS tropomi_no2, era5_blh, xco2_anomaly FROM tr")
def train_matrix(spark, sf):
    return split.train_matrix(split.temporal_split(zonal(spark, sf)), ["tropomi_no2", "era5_blh"])


@query("~weight #n", _Z + f"SELECT CASE WHEN tropomi_no2 >= (SELECT quantile_cont(tropomi_no2, 0.9) FROM z WHERE {_SPLIT} = 'train') THEN 5e0 ELSE 1e0 END AS weight, count(*) AS n FROM z GROUP BY 1")
def hotspot_weight(spark, sf):
    return stats.hotspot_weight(split.temporal_split(zonal(spark, sf))).groupBy("weight").agg(F.count("*").alias("n"))


@query("~r2 ~rmse ~r ~mean_obs ~mean_pred ~bias #n", _P + """SELECT 1 - sum((true_xco2 - pred_xco2) ** 2) / (var_pop(true_xco2) * count(*)) AS r2, sqrt(avg((true_xco2 - pred_xco2) ** 2)) AS rmse, corr(true_xco2, pred_xco2) AS r, avg(true_xco2) AS mean_obs, avg(pred_xco2) AS mean_pred, avg(pred_xco2 - true_xco2) AS bias, count(*) AS n FROM p""")
def regression_metrics(spark, sf):
    return stats.regression_metrics(predictions(spark, sf), "true_xco2", "pred_xco2")


@query("date ~obs_mean ~obs_std ~pred_mean #n", _P + "SELECT date, avg(true_xco2) AS obs_mean, stddev_samp(true_xco2) AS obs_std, avg(pred_xco2) AS pred_mean, count(*) AS n FROM p GROUP BY 1")
def daily_series(spark, sf):
    return stats.daily_series(predictions(spark, sf))


@query("%lat_idx %lon_idx ~obs_mean ~pred_mean ~bias #n", _P + "SELECT lat_idx, lon_idx, avg(true_xco2) AS obs_mean, avg(pred_xco2) AS pred_mean, avg(pred_xco2 - true_xco2) AS bias, count(*) AS n FROM p GROUP BY 1, 2")
def spatial_bias(spark, sf):
    return stats.spatial_bias(predictions(spark, sf))


@query("hotspot #n ~mean_xco2", _O + "SELECT CASE WHEN latitude BETWEEN 34 AND 41 AND longitude BETWEEN 113 AND 122 THEN 'north' ELSE 'delta' END AS hotspot, count(*) AS n, avg(xco2) AS mean_xco2 FROM o WHERE (latitude BETWEEN 34 AND 41 AND longitude BETWEEN 113 AND 122) OR (latitude BETWEEN 28.5e0 AND 33 AND longitude BETWEEN 118 AND 123) GROUP BY 1")
def hotspots(spark, sf):
    return stats.hotspots(supers(spark, sf), {"north": (34.0, 41.0, 113.0, 122.0), "delta": (28.5, 33.0, 118.0, 123.0)}).groupBy("hotspot").agg(F.count("*").alias("n"), F.avg("xco2").alias("mean_xco2"))


@query("date %lat_idx %lon_idx ~pred_xco2 ~true_xco2 ~background", _P + "SELECT * FROM p")
def reconstruct(spark, sf):
    return predictions(spark, sf)


@query("eaic_region #n ~mean ~std ~skewness ~kurtosis", _Z + """, k AS (SELECT eaic_region, count(xco2_anomaly) AS n, avg(xco2_anomaly) AS mean, stddev_pop(xco2_anomaly) AS std FROM z GROUP BY 1 HAVING count(xco2_anomaly) > 50)
SELECT k.eaic_region, any_value(k.n) AS n, any_value(k.mean) AS mean, any_value(k.std) AS std, avg((xco2_anomaly - k.mean) ** 3) / any_value(k.std) ** 3 AS skewness, avg((xco2_anomaly - k.mean) ** 4) / any_value(k.std) ** 4 - 3 AS kurtosis FROM z JOIN k USING (eaic_region) GROUP BY 1""")
def moments(spark, sf):
    return stats.moments(zonal(spark, sf), "xco2_anomaly", ["eaic_region"], 50)


@query("%bin ~low #n ~density", cte("soundings") + """, r AS (SELECT min(tropomi_no2) AS lo, (max(tropomi_no2) - min(tropomi_no2)) / 200 AS w, count(tropomi_no2) AS n FROM v_soundings),
b AS (SELECT least(CAST(floor((tropomi_no2 - lo) / w) AS INT), 199) AS bin, count(*) AS k FROM v_soundings, r WHERE tropomi_no2 IS NOT NULL GROUP BY 1) SELECT bin, lo + bin * w AS low, k AS n, k / (n * w) AS density FROM b, r""")
def histogram(spark, sf):
    return stats.histogram(soundings(spark, sf), "tropomi_no2")


@query("%bx %by #n ~log10_n", cte("soundings") + """, k AS (SELECT xco2 AS x, tropomi_no2 AS y FROM v_soundings WHERE tropomi_no2 IS NOT NULL), r AS (SELECT min(x) AS x0, (max(x) - min(x)) / 40 AS wx, min(y) AS y0, (max(y) - min(y)) / 40 AS wy FROM k)
SELECT least(CAST(floor((x - x0) / wx) AS INT), 39) AS bx, least(CAST(floor((y - y0) / wy) AS INT), 39) AS by, count(*) AS n, log10(count(*)) AS log10_n FROM k, r GROUP BY 1, 2""")
def density_2d(spark, sf):
    return stats.density_2d(soundings(spark, sf), "xco2", "tropomi_no2")


@query("~huber", _P + "SELECT avg(CASE WHEN abs(true_xco2 - pred_xco2) < 0.5e0 THEN 0.5e0 * (true_xco2 - pred_xco2) ** 2 ELSE 0.5e0 * abs(true_xco2 - pred_xco2) - 0.125e0 END) AS huber FROM p")
def huber(spark, sf):
    return stats.weighted_huber(predictions(spark, sf), "true_xco2", "pred_xco2")


@query("~huber", _P + "SELECT avg((CASE WHEN abs(true_xco2 - pred_xco2) < 0.5e0 THEN 0.5e0 * (true_xco2 - pred_xco2) ** 2 ELSE 0.5e0 * abs(true_xco2 - pred_xco2) - 0.125e0 END) * (1 + lat_idx)) AS huber FROM p")
def huber_weighted(spark, sf):
    return stats.weighted_huber(predictions(spark, sf).withColumn("weight", F.col("lat_idx") + F.lit(1)), "true_xco2", "pred_xco2", "weight")


@query("%lat_idx #n_months #n_cells", _O + "SELECT lat_idx, count(DISTINCT year_month) AS n_months, count(DISTINCT (lat_idx, lon_idx)) AS n_cells FROM o GROUP BY 1")
def distinct_from_days(spark, sf):
    """Distinct months and cells by latitude row, merged from partial results by day (D5, D6, D32)."""
    rows = supers(spark, sf)
    months, cells = (stats.merged_distinct(stats.distinct_partials(rows, n, ["date", "lat_idx"]), ["lat_idx"]) for n in (stats.month_number(), F.col("lat_idx") * G5.n_lon + F.col("lon_idx")))
    return months.withColumnRenamed("n_distinct", "n_months").join(cells.withColumnRenamed("n_distinct", "n_cells"), "lat_idx")


@query("%year #n_soundings near", cte("soundings") + "SELECT year(date) AS year, count(DISTINCT sounding_id) AS n_soundings, true AS near FROM v_soundings GROUP BY 1")
def sketches_from_days(spark, sf):
    """Approximate distinct soundings of a year, merged from sketches by day, are within 4 % (five standard errors) of the exact number."""
    rows = soundings(spark, sf).withColumn("year", F.year("date"))
    about = stats.merged_sketches(stats.distinct_sketches(rows, "sounding_id", ["year", "date"]), ["year"])
    exact = rows.groupBy("year").agg(F.count_distinct("sounding_id").alias("n_soundings"))
    return exact.join(about, "year").withColumn("near", F.abs(F.col("n_distinct") - F.col("n_soundings")) <= 0.04 * F.col("n_soundings"))


_QQ = 200
_NORMAL = ", ".join(  # the normal side, from the order statistics' medians
    f"({k}, {NormalDist().inv_cdf(1 - 0.5 ** (1 / _QQ) if k == 0 else 0.5 ** (1 / _QQ) if k == _QQ - 1 else (k + 1 - 0.3175) / (_QQ + 0.365))!r}e0)" for k in range(_QQ))


@query("%i ~theoretical ~ordered", _Z + f""", q AS (SELECT quantile_cont(xco2_anomaly, [{", ".join(repr(k / (_QQ - 1)) for k in range(_QQ))}]) AS v FROM z)
SELECT i, theoretical, v[i + 1] AS ordered FROM (VALUES {_NORMAL}) AS t(i, theoretical), q""")
def qq_points(spark, sf):
    return stats.qq_points(zonal(spark, sf), "xco2_anomaly", _QQ)


@query("~slope ~intercept ~r2", _Z + f""", q AS (SELECT quantile_cont(xco2_anomaly, [{", ".join(repr(k / (_QQ - 1)) for k in range(_QQ))}]) AS v FROM z)
SELECT regr_slope(v[i + 1], theoretical) AS slope, regr_intercept(v[i + 1], theoretical) AS intercept, regr_r2(v[i + 1], theoretical) AS r2 FROM (VALUES {_NORMAL}) AS t(i, theoretical), q""")
def qq_fit(spark, sf):
    return stats.qq_fit(stats.qq_points(zonal(spark, sf), "xco2_anomaly", _QQ))


@query("first last #n_dates #n_months #n_rows", cte("soundings") + "SELECT min(date) AS first, max(date) AS last, count(DISTINCT date) AS n_dates, count(DISTINCT date_trunc('month', date)) AS n_months, count(*) AS n_rows FROM v_soundings")
def date_coverage(spark, sf):
    return stats.date_coverage(soundings(spark, sf))


# --- splits


@query("split %year #n", _Z + f"SELECT {_SPLIT} AS split, year, count(*) AS n FROM z GROUP BY 1, 2")
def temporal_split(spark, sf):
    return split.temporal_split(zonal(spark, sf)).groupBy("split", "year").agg(F.count("*").alias("n"))


@query("split %year #n", _Z + "SELECT CASE year WHEN 2001 THEN 'test' WHEN 2000 THEN 'val' ELSE 'train' END AS split, year, count(*) AS n FROM z GROUP BY 1, 2")
def last_years_split(spark, sf):
    return split.last_years_split(zonal(spark, sf)).groupBy("split", "year").agg(F.count("*").alias("n"))


@query("date %lat_idx %lon_idx ~xco2_anomaly", _Z + "SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY abs(xco2_anomaly) DESC, date) <= 15")
def cap_per_cell(spark, sf):
    return split.cap_per_cell(zonal(spark, sf))


@query("region split #n", _Z + f""", g AS (SELECT region, {_SPLIT} AS split, count(*) AS n FROM z GROUP BY 1, 2), k AS (SELECT g.*, sum(n) OVER (PARTITION BY region) AS whole, (SELECT sum(n) FROM g WHERE region = 'Korea_Japan') * CASE region WHEN 'West_China' THEN 3e0 WHEN 'East_China' THEN 2e0 ELSE 1e0 END AS target FROM g)
SELECT region, split, CASE WHEN whole > target THEN greatest(1, round_even(target * n / whole, 0)) ELSE n END AS n FROM k""")
def undersample_counts(spark, sf):
    rows = split.temporal_split(zonal(spark, sf))
    return split.undersample(rows, ["date", *grid.K]).groupBy("region", "split").agg(F.count("*").alias("n"))


# --- collocation


@query("sounding_id date ~distance ~no2_tvcd_umol", cte("probes", "pixels") + """, d AS (SELECT q.sounding_id, q.date, (p.lat - q.latitude) ** 2 + (p.lon - q.longitude) ** 2 AS d2, p.lat, p.lon, p.no2_tvcd_umol AS v FROM v_probes q JOIN v_pixels p ON p.date = q.date),
b AS (SELECT sounding_id, sqrt(d2) AS distance, v AS no2_tvcd_umol FROM d QUALIFY row_number() OVER (PARTITION BY sounding_id ORDER BY d2, lat, lon, v) = 1)
SELECT q.sounding_id, q.date, b.distance, b.no2_tvcd_umol FROM v_probes q LEFT JOIN b USING (sounding_id)""")
def nearest_join(spark, sf):
    return collocate.nearest_join(view(spark, sf, "probes"), view(spark, sf, "pixels"), ["no2_tvcd_umol"], cell=1.0)


_FIVE = {"u_max": "max(u10)", "v_max": "max(v10)", "b_max": "max(blh)", "u_min": "min(u10)", "v_min": "min(v10)"}


@query("sounding_id ~distance " + " ".join(f"~{c}" for c in _FIVE), cte("probes", "weather_hourly") + f""", w AS (SELECT date, lat, lon, {", ".join(f"{e} AS {c}" for c, e in _FIVE.items())} FROM v_weather_hourly GROUP BY 1, 2, 3),
d AS (SELECT q.sounding_id, (w.lat - q.latitude) ** 2 + (w.lon - q.longitude) ** 2 AS d2, w.* FROM v_probes q JOIN w ON w.date = q.date), b AS (SELECT sounding_id, sqrt(d2) AS distance, {", ".join(_FIVE)} FROM d QUALIFY row_number() OVER (PARTITION BY sounding_id ORDER BY d2, lat, lon) = 1)
SELECT q.sounding_id, distance, {", ".join(_FIVE)} FROM v_probes q LEFT JOIN b USING (sounding_id)""")
def nearest_weather(spark, sf):
    daily = view(spark, sf, "weather_hourly").groupBy("date", "lat", "lon").agg(*(F.expr(e).alias(c) for c, e in _FIVE.items()))
    return collocate.nearest_join(view(spark, sf, "probes"), daily, list(_FIVE), cell=10.0)


# winds in eighths: their sums are exact in any order, so means and their half-even rounding have to agree to the last digit
_DAILY = """, e AS (SELECT date, lat, lon, avg(u10) FILTER (WHERE NOT isnan(u10)) AS u, avg(v10) AS v, avg(blh) AS b FROM v_weather_eighths GROUP BY 1, 2, 3),
g AS (SELECT date, lat, lon, round_even(u, 6) AS u10_daily, round_even(v, 6) AS v10_daily, round_even(b, 4) AS blh_daily, round_even(sqrt(u * u + v * v), 4) AS wind_speed_daily,
 round_even((degrees(atan2(u, v)) + 360e0) % 360e0, 2) AS wind_dir_deg_daily FROM e)"""


@query("sounding_id ~u10_daily ~v10_daily", cte("probes", "weather_eighths") + _DAILY + """
SELECT sounding_id, u10_daily, v10_daily FROM v_probes q LEFT JOIN g ON g.date = q.date AND g.lat = 20 + 10 * ceil((latitude - 20) / 10 - 0.5e0) AND g.lon = 100 + 10 * ceil((longitude - 100) / 10 - 0.5e0)""")
def grid_join(spark, sf):
    return collocate.grid_join(view(spark, sf, "probes"), collocate.weather_daily(view(spark, sf, "weather_eighths")), ["u10_daily", "v10_daily"], 20.0, 100.0, 10.0)


@query("sounding_id ~population ~emission", cte("soundings", "raster_static", "raster_monthly") + """
SELECT s.sounding_id, a.value AS population, b.value AS emission FROM v_soundings s LEFT JOIN v_raster_static a ON a."row" = floor((50 - latitude) / 5) AND a.col = floor((longitude - 100) / 5)
LEFT JOIN v_raster_monthly b ON b."row" = floor((50 - latitude) / 5) AND b.col = floor((longitude - 100) / 5) AND b.year = year(s.date) AND b.month = month(s.date)""")
def raster_sample(spark, sf):
    s = grid.calendar_cols(soundings(spark, sf))
    s = collocate.sample_raster(s, view(spark, sf, "raster_static"), collocate.Transform(), "population")
    return collocate.sample_raster(s, view(spark, sf, "raster_monthly"), collocate.Transform(), "emission", by=["year", "month"])


@query("sounding_id ~emission", cte("soundings", "raster_monthly") + """
SELECT s.sounding_id, b.value AS emission FROM v_soundings s LEFT JOIN v_raster_monthly b ON b."row" = floor((50 - latitude) / 5) AND b.col = floor((longitude - 100) / 5) AND b.year = year(s.date) AND b.month = month(s.date)""")
def raster_tiles(spark, sf):
    folder = io.scratch_dir(spark)
    io.write_raster_tiles(view(spark, sf, "raster_monthly"), folder, 3)
    return collocate.sample_tiles(grid.calendar_cols(soundings(spark, sf)), spark.read.parquet(folder), collocate.Transform(), "emission", 3)


@query("date %hour", cte("granules") + "SELECT DISTINCT date, unnest(range(hour(time_start), hour(time_end) + 1)) AS hour FROM v_granules WHERE hour(time_end) >= hour(time_start)")
def overpass_hours(spark, sf):
    return collocate.overpass_hours(view(spark, sf, "granules"))


@query("date %hour ~lat ~lon ~u10_obs ~u10_daily obs_time", cte("granules", "weather_hourly") + """, h AS (SELECT DISTINCT date, unnest(range(hour(time_start), hour(time_end) + 1)) AS hour FROM v_granules WHERE hour(time_end) >= hour(time_start)),
w AS (SELECT *, avg(u10) OVER (PARTITION BY date, lat, lon) AS u10_daily FROM v_weather_hourly) SELECT w.date, w.hour, lat, lon, u10 AS u10_obs, u10_daily, lpad(CAST(w.hour AS VARCHAR), 2, '0') || ':00' AS obs_time FROM w JOIN h ON w.date = h.date AND w.hour = h.hour""")
def weather_at_overpass(spark, sf):
    return collocate.weather_at_overpass(view(spark, sf, "weather_hourly"), collocate.overpass_hours(view(spark, sf, "granules")))


@query("date ~lat ~lon ~u10_daily ~v10_daily ~blh_daily ~wind_speed_daily ~wind_dir_deg_daily", cte("weather_eighths") + _DAILY + " SELECT * FROM g")
def weather_daily(spark, sf):
    return collocate.weather_daily(view(spark, sf, "weather_eighths"))


@query("~lat ~lon ~fluxes_1996 ~fluxes_1997", cte("inventory") + """, a AS (SELECT lat, lon, sum(fluxes) AS fluxes_1996 FROM v_inventory WHERE year = 1996 AND month = 1 GROUP BY 1, 2), b AS (SELECT lat, lon, sum(fluxes) AS fluxes_1997 FROM v_inventory WHERE year = 1997 AND month = 1 GROUP BY 1, 2) SELECT * FROM a JOIN b USING (lat, lon)""")
def compare_years(spark, sf):
    return collocate.compare_years(view(spark, sf, "inventory"), 1996, 1997)


@query("%year sector ~total #n", cte("inventory") + "SELECT year, sector, sum(fluxes) AS total, count(*) AS n FROM v_inventory GROUP BY 1, 2")
def sector_totals(spark, sf):
    return diagnose.sector_totals(view(spark, sf, "inventory"))


# --- diagnosis


@query("region #n ~pct", _O + "SELECT region, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER () AS pct FROM o GROUP BY 1")
def region_counts(spark, sf):
    return diagnose.region_counts(supers(spark, sf))


@query("%lat_band #East_China #West_China #total", _O + "SELECT lat_band, count(*) FILTER (WHERE region = 'East_China') AS East_China, count(*) FILTER (WHERE region = 'West_China') AS West_China, count(*) AS total FROM o GROUP BY ROLLUP (lat_band)")
def region_latband_crosstab(spark, sf):
    return diagnose.region_latband_crosstab(supers(spark, sf), ["East_China", "West_China"])


_LOAD = "SELECT lat_idx, lon_idx, region, count(*) AS n, round(avg(latitude), 2) AS lat, round(avg(longitude), 2) AS lon FROM o GROUP BY 1, 2, 3"


@query("region #n_cells ~mean ~median #max ~p95", _O + f"SELECT region, count(*) AS n_cells, avg(n) AS mean, median(n) AS median, max(n) AS max, quantile_cont(n, 0.95) AS p95 FROM ({_LOAD}) GROUP BY 1")
def cell_load_stats(spark, sf):
    return diagnose.cell_load_stats(supers(spark, sf))


@query("~gini", _O + ", n AS (SELECT region, CAST(count(*) AS DOUBLE) AS x FROM o GROUP BY 1), k AS (SELECT x, row_number() OVER (ORDER BY x, region) AS i FROM n) SELECT 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1e0) / count(*) AS gini FROM k")
def gini(spark, sf):
    return diagnose.gini(supers(spark, sf))


@query("%cap", _O + f"SELECT floor(quantile_cont(n, 0.95)) AS cap FROM ({_LOAD})")
def recommended_cap(spark, sf):
    return diagnose.recommended_cap(supers(spark, sf))


@query("%lat_idx %lon_idx region #n ~lat ~lon", _O + f"SELECT * FROM ({_LOAD}) ORDER BY n DESC, lat_idx, lon_idx, region LIMIT 20")
def densest_cells(spark, sf):
    return diagnose.densest_cells(supers(spark, sf))


# --- frames, equations, files


@query("date %lat_idx %lon_idx observed ~xco2_anomaly ^tropomi_no2", _Z + """SELECT date, CAST(trunc((latitude - 20) / 0.25e0) AS INT) AS lat_idx, CAST(trunc((longitude - 100) / 0.25e0) AS INT) AS lon_idx, coalesce(xco2_anomaly <> 0, false) AS observed, coalesce(xco2_anomaly, 0) AS xco2_anomaly, coalesce(tropomi_no2, 0) AS tropomi_no2 FROM z
QUALIFY row_number() OVER (PARTITION BY date, trunc((latitude - 20) / 0.25e0), trunc((longitude - 100) / 0.25e0) ORDER BY lat_idx DESC, lon_idx DESC) = 1""".replace("FROM z", "FROM (SELECT date, latitude, longitude, xco2_anomaly, tropomi_no2, lat_idx AS a, lon_idx AS b FROM z)").replace("ORDER BY lat_idx DESC, lon_idx DESC", "ORDER BY a DESC, b DESC"))
def daily_frames(spark, sf):
    z = zonal(spark, sf).withColumn("a", F.col("lat_idx")).withColumn("b", F.col("lon_idx"))
    return frames.daily_frames(z, ["xco2_anomaly", "tropomi_no2"], order=["a", "b"])


@query("#seq %step date #n ~total", _Z + """, t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS k FROM (SELECT DISTINCT date FROM z)), w AS (SELECT date, t - step AS seq, step FROM t, (SELECT unnest([0, 1, 2]) AS step) WHERE t - step >= 0 AND t - step < k - 3)
SELECT seq, step, w.date, count(*) AS n, sum(xco2_anomaly) AS total FROM z JOIN w USING (date) GROUP BY 1, 2, 3""")
def sequences(spark, sf):
    return frames.sequences(zonal(spark, sf)).groupBy("seq", "step", "date").agg(F.count("*").alias("n"), F.sum("xco2_anomaly").alias("total"))


def _grid_model(x):
    """A fixed linear model: two channels of three days, and the western neighbour's first channel on the last."""
    out = 0.25 + 0.01 * x[:, 2, 0] + 0.005 * x[:, 1, 0] - 0.003 * x[:, 0, 0] + 0.1 * x[:, 2, 1]
    out[:, :, 1:] += 0.02 * x[:, 2, 0, :, :-1]
    return out


@query("#seq date %lat_idx %lon_idx ^prediction", _Z + """, f AS (SELECT date, lat_idx, lon_idx, coalesce(xco2_anomaly <> 0, false) AS observed, coalesce(tropomi_no2, 0) AS no2, coalesce(era5_u10, 0) AS u FROM z),
t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS k FROM (SELECT DISTINCT date FROM f)), w AS (SELECT c.t - 2 AS seq, a.date AS d0, b.date AS d1, c.date AS d2 FROM t c JOIN t b ON b.t = c.t - 1 JOIN t a ON a.t = c.t - 2 WHERE c.t - 2 < c.k - 3)
SELECT seq, d2 AS date, c.lat_idx, c.lon_idx, 0.25e0 + 0.01e0 * c.no2 + 0.005e0 * coalesce(b.no2, 0) - 0.003e0 * coalesce(a.no2, 0) + 0.1e0 * c.u + 0.02e0 * coalesce(e.no2, 0) AS prediction
FROM w JOIN f c ON c.date = d2 LEFT JOIN f b ON b.date = d1 AND b.lat_idx = c.lat_idx AND b.lon_idx = c.lon_idx LEFT JOIN f a ON a.date = d0 AND a.lat_idx = c.lat_idx AND a.lon_idx = c.lon_idx
LEFT JOIN f e ON e.date = d2 AND e.lat_idx = c.lat_idx AND e.lon_idx = c.lon_idx - 1 WHERE c.observed""")
def score_sequences(spark, sf):
    made = frames.daily_frames(zonal(spark, sf), ["xco2_anomaly", "tropomi_no2", "era5_u10"], G5)
    return frames.score_sequences(frames.sequences(made), _grid_model, ["tropomi_no2", "era5_u10"], G5)


EQUATIONS = {
    "mean": ("0.5D + 0 * tropomi_no2", 3), "linear": ("tropomi_no2 / 100D", 5), "wind": ("tropomi_no2 / (era5_blh + 1000D)", 9),
    "root": ("sqrt(abs(tropomi_no2)) / 10D - 0.5D", 15), "long": ("(tropomi_no2 - 50D) / 50D + era5_u10 / 10D", 22),
}
_EQ = " UNION ALL ".join(f"SELECT '{n}' AS equation, {c} AS complexity, {e.replace('D', 'e0')} AS p, xco2_anomaly AS t FROM z" for n, (e, c) in EQUATIONS.items())
_SCORED = _Z + f""", e AS ({_EQ}), g AS (SELECT equation, complexity, 1 - sum((t - p) ** 2) / (var_pop(t) FILTER (WHERE p IS NOT NULL) * count(p)) AS r2, sqrt(avg((t - p) ** 2)) AS rmse,
avg(CASE WHEN abs(t - p) < 0.5e0 THEN 0.5e0 * (t - p) ** 2 ELSE 0.5e0 * abs(t - p) - 0.125e0 END) AS loss FROM e GROUP BY 1, 2)"""


@query("equation %complexity ~r2 ~rmse ~loss", _SCORED + " SELECT * FROM g")
def score_equations(spark, sf):
    return equations.score_equations(zonal(spark, sf), EQUATIONS, "xco2_anomaly")


@query("equation %complexity ~loss", _SCORED + " SELECT * FROM g WHERE complexity BETWEEN 5 AND 15 ORDER BY loss LIMIT 3")
def best_equations(spark, sf):
    return equations.best_equations(equations.score_equations(zonal(spark, sf), EQUATIONS, "xco2_anomaly"))


@query("%month #n", cte("soundings") + "SELECT month(date) AS month, count(*) AS n FROM v_soundings WHERE file_source NOT IN (SELECT file_source FROM v_soundings WHERE snd_operation_mode = 9 OR file_source = 'other.csv') GROUP BY 1")
def new_files_only(spark, sf):
    s = soundings(spark, sf).withColumnRenamed("file_source", "filename")
    return io.new_files_only(s, s.where("filename = 'other.csv'")).groupBy(F.month("date").alias("month")).agg(F.count("*").alias("n"))

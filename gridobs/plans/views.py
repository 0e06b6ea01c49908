"""Observation tables derived from the driver's tables: the same text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {"soundings": ("lineitem",), "pixels": ("events",), "probes": ("events",), "weather_hourly": ("events",), "weather_eighths": ("events",), "granules": ("events",), "raster_static": ("part",), "raster_monthly": ("orders",), "inventory": ("orders",)}

VIEWS = {
    "soundings": """
SELECT l_orderkey * 1000 + l_linenumber AS sounding_id,
       CAST(date_trunc('month', l_shipdate) AS DATE) + 7 * (l_linenumber % 4) AS date,
       CAST(19.5e0 + (l_partkey % 125) * 0.25e0 + (l_suppkey % 4) * 0.0625e0 AS DOUBLE) AS latitude,
       CAST(99.0e0 + ((l_orderkey * 7 + l_suppkey) % 104) * 0.5e0 + (l_partkey % 8) * 0.0625e0 AS DOUBLE) AS longitude,
       CAST(392.0e0 + l_discount * 100e0 + l_tax * 50e0 + l_quantity * 0.5e0 AS DOUBLE) AS xco2,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice / 400e0 - 60e0 END AS tropomi_no2,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS xco2_quality_flag,
       CASE WHEN l_linenumber % 7 = 0 THEN 1 ELSE 0 END AS ret_snow_flag,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_discount * 10e0 END AS ret_aod_total,
       CASE WHEN l_partkey % 50 = 0 THEN 'other.csv' WHEN l_linestatus = 'F' THEN 'oco2_east_asia_2020.csv' ELSE 'oco3_east_asia_2020.csv' END AS file_source,
       CAST(l_linenumber % 3 AS INT) AS snd_operation_mode,
       CAST(l_suppkey % 3 AS INT) AS snd_land_water_indicator,
       CAST((l_quantity - 25e0) / 4e0 AS DOUBLE) AS era5_u10,
       CAST((l_partkey % 9) * 1.5e0 - 6e0 AS DOUBLE) AS era5_v10,
       CAST(l_quantity * 40e0 - 60e0 AS DOUBLE) AS era5_blh,
       CAST((l_partkey % 20) * 2.5e0 AS DOUBLE) AS odiac_emission,
       CAST(l_suppkey * 10e0 - 5e0 AS DOUBLE) AS population_density
FROM lineitem""",
    "pixels": """
SELECT event_id AS pixel_id, CAST(ts AS DATE) AS date,
       CAST(20e0 + ((event_id * 37) % 480) * 0.0625e0 AS DOUBLE) AS lat,
       CAST(100e0 + ((event_id * 91) % 800) * 0.0625e0 AS DOUBLE) AS lon,
       value AS no2_tvcd_umol, CAST((user_id % 4) * 0.25e0 + 0.25e0 AS DOUBLE) AS qa
FROM events WHERE event_type <> 'purchase'""",
    "probes": """
SELECT event_id AS sounding_id, CAST(ts AS DATE) AS date,
       CAST(20e0 + ((event_id * 53 + 7) % 960) * 0.03125e0 AS DOUBLE) AS latitude,
       CAST(100e0 + ((event_id * 17 + 3) % 1600) * 0.03125e0 AS DOUBLE) AS longitude
FROM events WHERE event_type = 'purchase'""",
    "weather_hourly": """
SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour,
       CAST(20e0 + (user_id % 4) * 10e0 AS DOUBLE) AS lat, CAST(100e0 + (event_id % 6) * 10e0 AS DOUBLE) AS lon,
       CAST(value / 20e0 - 12e0 AS DOUBLE) AS u10, CAST((user_id % 9) * 1.5e0 - 6e0 AS DOUBLE) AS v10, CAST(value * 3e0 AS DOUBLE) AS blh
FROM events""",
    "weather_eighths": """
SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour,
       CAST(20e0 + (user_id % 4) * 10e0 AS DOUBLE) AS lat, CAST(100e0 + (event_id % 6) * 10e0 AS DOUBLE) AS lon,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE floor(value) / 8e0 - 12e0 END AS u10,
       CAST((user_id % 9) * 1.5e0 - 6e0 AS DOUBLE) AS v10, CAST(floor(value * 3e0) / 4e0 AS DOUBLE) AS blh
FROM events""",
    "granules": """
SELECT CAST(ts AS DATE) AS date, ts AS time_start, ts + INTERVAL '100' MINUTE AS time_end FROM events WHERE event_type = 'signup'""",
    "raster_static": """
SELECT CAST(p_partkey % 6 AS INT) AS "row", CAST((p_partkey * 7) % 10 AS INT) AS col, CAST(max(p_retailprice) AS DOUBLE) AS value FROM part GROUP BY 1, 2""",
    "raster_monthly": """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(o_custkey % 6 AS INT) AS "row", CAST((o_custkey * 7) % 10 AS INT) AS col, max(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3, 4""",
    "inventory": """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, o_orderpriority AS sector,
       CAST(20e0 + (o_custkey % 30) AS DOUBLE) AS lat, CAST(100e0 + (o_custkey % 50) AS DOUBLE) AS lon, CAST(o_totalprice - 20000e0 AS DOUBLE) AS fluxes
FROM orders""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the files of ``sf_dir``; the table names are resolved to DataFrames without touching the session's catalog."""
    (source,) = TABLES[name]
    text = VIEWS[name].replace('"row"', "`row`").replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(text, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def cte(*names: str) -> str:
    """The views as the beginning of a DuckDB query."""
    return "WITH " + ",\n".join(f"v_{n} AS ({VIEWS[n]})" for n in names)

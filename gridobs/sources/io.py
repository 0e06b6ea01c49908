"""Readers and writers: observation files in, date-partitioned Parquet and reports out."""

from __future__ import annotations

import csv
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, DoubleType, NumericType

from gridobs.functions.columns import null_if_missing, tile_name

#: Columns kept of a sounding file, with the types to read them as.
SOUNDING_COLUMNS = {
    "sounding_id": "long", "date": "string", "latitude": "double", "longitude": "double", "tai_seconds": "double", "xco2": "double", "xco2_x2019": "double",
    "xco2_uncertainty": "double", "xco2_apriori": "double", "ret_psurf": "double", "ret_tcwv": "double", "ret_tcwv_uncertainty": "double",
    "ret_aod_total": "double", "ret_aod_dust": "double", "ret_aod_water": "double", "ret_aod_ice": "double", "solar_zenith_angle": "double",
    "sensor_zenith_angle": "double", "snd_airmass": "double", "snd_land_fraction": "double", "snd_glint_angle": "double", "snd_altitude": "double",
    "xco2_quality_flag": "int", "xco2_qf_bitflag": "int", "xco2_qf_simple_bitflag": "int", "ret_snow_flag": "int", "ret_surface_type": "int",
    "snd_operation_mode": "int", "snd_land_water_indicator": "int",
}
#: Daily weather columns of a weather file and their names here.
WEATHER_COLUMNS = {"u10_daily": "era5_u10", "v10_daily": "era5_v10", "blh_daily": "era5_blh", "wind_speed_daily": "era5_wind_speed", "wind_dir_deg_daily": "era5_wind_dir"}


#: Columns that some files name otherwise: a sounding file's float ``time`` holds TAI seconds.
OTHER_NAMES = {"time": "tai_seconds"}


def file_headers(spark: SparkSession, paths: Sequence[str], pattern: str = "*.csv", at_once: int = 32) -> dict[str, list[str]]:
    """The files below ``paths`` by their first line; empty files are left out.

    Spark lists the files and its file systems open them, ``at_once`` at a time, for the first line only. A job would have to read the files through: tasks can't stop after a line.
    """
    files = sorted(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(list(paths)).inputFiles())
    conf = spark._jsc.hadoopConfiguration()

    def header(file: str) -> str | None:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        stream = where.getFileSystem(conf).open(where)
        try:
            line = stream.readLine()  # a character a byte
        finally:
            stream.close()
        return None if line is None else line.encode("latin-1").decode("utf-8", "replace")

    found: dict[str, list[str]] = {}
    with ThreadPool(at_once) as pool:
        for file, line in zip(files, pool.map(header, files)):
            if line is not None:
                found.setdefault(line, []).append(file)
    return found


def header_names(header: str) -> list[str]:
    """Column names of a header line, without byte-order mark and blanks around."""
    return [n.strip() for n in next(csv.reader([header.lstrip("\ufeff")]), [])]


def _literal(path: str) -> str:
    """A file's URI as a path that the reader takes word for word, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def read_soundings(spark: SparkSession, paths: Sequence[str], keep: dict[str, str] | None = None, other_names: dict[str, str] | None = None) -> DataFrame:
    """CSV files below ``paths``, whatever their headers: kept columns only, united by name; absent columns are NULL, values that don't fit their type too. Adds ``file_source``.

    Every file's header is read first. Files of one header are one typed scan, so there are as many scans as headers, and files may differ in order and set of columns.
    A name that occurs twice in a header counts where it stands first; ``other_names`` are taken for the kept name unless the file has that as well. No files: no rows.
    """
    keep, other = keep or SOUNDING_COLUMNS, OTHER_NAMES if other_names is None else other_names
    found: dict[tuple[str, ...], list[str]] = {}
    for header, files in file_headers(spark, paths).items():
        found.setdefault(tuple(header_names(header)), []).extend(map(_literal, files))
    parts = [_read_header(spark, names, files, keep, other) for names, files in found.items()]
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in keep.items()) + ", file_source string")
    return reduce(DataFrame.unionByName, parts)


def _read_header(spark: SparkSession, names: Sequence[str], files: list[str], keep: dict[str, str], other: dict[str, str]) -> DataFrame:
    """All kept columns of files with this header; columns are read by their place."""
    at: dict[str, int] = {}
    for i, n in enumerate(names):
        at.setdefault(n, i)
    for n, kept in other.items():
        if n in at and n not in keep:
            at.setdefault(kept, at[n])
    schema = ", ".join(f"`_{i}` string" for i in range(len(names)))
    raw = spark.read.schema(schema).option("header", True).csv(files)
    columns = [(F.expr(f"try_cast(`_{at[c]}` AS {t})") if c in at else F.lit(None).cast(t)).alias(c) for c, t in keep.items()]
    return raw.select(*columns, _base_name().alias("file_source"))


def _base_name() -> Column:
    """Lower-case base name of the file that a row is read from, without the escapes of its URI."""
    return F.lower(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))))


def with_file_source(df: DataFrame) -> DataFrame:
    """Lower-case base name of the source file; ``file_name`` if there, else the reader's own metadata."""
    return df.withColumn("file_source", F.lower(F.col("file_name")) if "file_name" in df.columns else _base_name())


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path for intermediate files, below the one that ``spark.checkpoint.dir`` names and driver and executors share.

    A folder of our own is taken only where none is named and driver and tasks share one machine; elsewhere that is an error.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{named or tempfile.mkdtemp(prefix='gridobs-')}/{uuid.uuid4().hex}"


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows placed by ``keys`` in tasks of about the session's advisory size: Spark measures the shuffle, deals a key of many rows over several tasks and puts small keys together."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(f'`{k}`' for k in keys)}) */ * FROM {{df}}", df=df)


def _sorted_files(df: DataFrame) -> DataFrame:
    """Rows sorted inside each task by time, or else by date and cell, as far as there are such columns; files then have narrow ranges to skip by."""
    names = next((n for n in (["time"], ["tai_seconds"], ["date", "lat_idx", "lon_idx"]) if set(n) <= set(df.columns)), [])
    return df.sortWithinPartitions(*(["date"] if "date" in df.columns and "date" not in names else []), *names) if names else df


def write_by_date(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per date, zstd Parquet, files sorted by time; as many files as the date's size asks for."""
    _sorted_files(_dealt(df, "date")).write.mode(mode).partitionBy("date").option("compression", "zstd").parquet(path)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return daily_weather(spark.read.parquet(path))


def daily_weather(df: DataFrame) -> DataFrame:
    """Daily columns under their names here, one row per date and point (the source repeats a day for each observed hour)."""
    have = {a: b for a, b in WEATHER_COLUMNS.items() if a in df.columns}
    return df.select("date", "lat", "lon", *(F.col(a).alias(b) for a, b in have.items())).dropDuplicates(["date", "lat", "lon"])


def normalize_missing(df: DataFrame, fills: dict[str, float] | None = None, nonneg: Sequence[str] = ("population_density",)) -> DataFrame:
    """NaN and fill values become NULL, and negative values of ``nonneg`` columns (raster nodata) too."""
    fills = fills or {}
    out = {}
    for f in df.schema.fields:
        floating = isinstance(f.dataType, (FloatType, DoubleType))
        if floating or f.name in fills:
            c = null_if_missing(f.name, fills.get(f.name), floating)
            out[f.name] = F.when(c >= 0, c) if f.name in nonneg else c
    return df.withColumns(out)


def missing_counts(df: DataFrame) -> dict[str, int]:
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    bad = [F.sum((F.col(f.name).isNull() | (F.isnan(f.name) if isinstance(f.dataType, (FloatType, DoubleType)) else F.lit(False))).cast("long")).alias(f.name) for f in numeric]
    row = df.agg(*bad).first() if bad else {}
    return {f.name: row[f.name] or 0 for f in numeric}


def write_ml_ready(df: DataFrame, path: str) -> None:
    """Refuses (ValueError with the counts) while a numeric column still has NULL or NaN."""
    bad = {c: n for c, n in missing_counts(df).items() if n}
    if bad:
        raise ValueError(f"missing values left: {bad}")
    _sorted_files(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_by_sensor_year(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A folder per sensor and year, in sorted files of about equal size."""
    _sorted_files(_dealt(df, "sensor", "year")).write.mode("overwrite").partitionBy("sensor", "year").option("header", True).format(fmt).save(path)


def write_monthly_cube(cube: DataFrame, path: str) -> None:
    _dealt(cube, "year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_raster_tiles(raster: DataFrame, path: str, tile: int = 1024, by: Sequence[str] = ("year", "month")) -> None:
    """A raster's pixels (``row, col, value`` and ``by``) in a folder per month and tile of ``tile`` x ``tile`` pixels, for ``collocate.sample_tiles``."""
    tiled = raster.select(*by, "row", "col", "value", tile_name(F.col("row"), F.col("col"), tile, by).alias("tile"))
    _dealt(tiled, "tile").sortWithinPartitions("tile", "row", "col").write.mode("overwrite").partitionBy("tile").option("compression", "zstd").parquet(path)


def new_files_only(incoming: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of files that the output doesn't have yet."""
    return incoming.join(done.select("filename").distinct(), "filename", "left_anti")


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    """Runs below ``path`` whose manifest is whole: Spark's committer writes its mark last."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*/_SUCCESS")
    marks = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    return sorted(m.getPath().getParent().getName() for m in marks or [])


def finished_files(spark: SparkSession, path: str, key: str = "filename") -> DataFrame:
    """Names of the files whose rows ``path`` holds, from the manifests alone."""
    runs = finished_runs(spark, path)
    return spark.read.schema(f"`{key}` string").parquet(*(f"{path}/manifest/{r}" for r in runs)) if runs else spark.createDataFrame([], f"`{key}` string")


def _write_manifest(spark: SparkSession, path: str, run: str, key: str) -> None:
    written = spark.read.parquet(f"{path}/data/run={run}").select(F.col(key).cast("string").alias(key))
    written.distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{run}")


def append_run(rows: DataFrame, path: str, run: str, partition_by: Sequence[str] = (), key: str = "filename") -> None:
    """Write ``rows`` as the run ``run`` of ``path``: data first, then the manifest of their files, which makes the run count.

    A run that has its manifest is left as it is; one that broke off before is written anew, so a repeated call gives every row once.
    """
    spark = rows.sparkSession
    if run in finished_runs(spark, path):
        return
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/data/run={run}")
    _write_manifest(spark, path, run, key)


def append_new_files(incoming: DataFrame, path: str) -> None:
    """Append the rows of files that no finished run of ``path`` holds yet."""
    append_run(new_files_only(incoming, finished_files(incoming.sparkSession, path)), path, f"files-{uuid.uuid4().hex}")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the finished runs of ``path``; what an unfinished run left is not read. Without finished runs there is nothing to read (ValueError)."""
    runs = finished_runs(spark, path)
    if not runs:
        raise ValueError(f"no finished run below {path}")
    return spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/run={r}" for r in runs)).drop("run")


def write_splits(df: DataFrame, path: str) -> None:
    """Rows by split in sorted files of about equal size, and one line of metadata (rows per split) beside them."""
    _sorted_files(_dealt(df, "split")).write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    counts = df.groupBy("split").count()
    counts.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "count"))))).alias("value")).write.mode("overwrite").text(f"{path}/metadata")


def write_inventory(df: DataFrame, path: str) -> None:
    _dealt(df, "year", "sector").write.mode("overwrite").partitionBy("year", "sector").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_scalers(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_scalers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

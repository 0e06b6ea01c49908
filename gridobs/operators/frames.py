"""Daily frames and sequences of frames for grid models, in sparse long form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridobs.functions.columns import Grid
from gridobs.operators.grid import K


def daily_frames(df: DataFrame, channels: Sequence[str], grid: Grid = Grid(res=0.25), order: Sequence[str] = ()) -> DataFrame:
    """One row per date and cell: channel values (NULL becomes 0) and ``observed``, where the first channel is not 0; of several rows in a cell the last in ``order`` counts.

    Cells are clipped to the grid. Absent cells are 0 when a frame is made dense.
    """
    clip = lambda c, low, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), ((F.col(c) - F.lit(low)) / F.lit(grid.res)).cast("int")))
    rows = df.withColumn("lat_idx", clip("latitude", grid.lat_min, grid.n_lat)).withColumn("lon_idx", clip("longitude", grid.lon_min, grid.n_lon))
    by = [F.desc_nulls_last(c) for c in order] or [F.desc_nulls_last(c) for c in channels]
    last = F.row_number().over(Window.partitionBy("date", *K).orderBy(*by))
    rows = rows.withColumn("_k", last).where("_k = 1")
    return rows.select("date", *K, F.coalesce(F.col(channels[0]) != 0, F.lit(False)).alias("observed"), *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in channels))


def dense_frames(frames: DataFrame, channel: str, grid: Grid = Grid(res=0.25)) -> DataFrame:
    """``date, frame``: all cells of a channel as one array, row by row."""
    cells = frames.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct((F.col("lat_idx") * grid.n_lon + F.col("lon_idx")).alias("k"), F.col(channel).alias("v")))).alias("m"))
    return cells.select("date", F.transform(F.sequence(F.lit(0), F.lit(grid.n_lat * grid.n_lon - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("frame"))


def date_ranks(df: DataFrame) -> DataFrame:
    """``date, t``: observed dates numbered from 0 (one row per date, whatever the number of observations)."""
    return df.select("date").distinct().withColumn("t", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)


def sequences(df: DataFrame, length: int = 3) -> DataFrame:
    """Rows of each sliding window of ``length`` successive observed dates: ``seq`` (from 0), ``step``, and ``is_target`` in the last step.

    As many windows as dates less ``length``: the last possible one is left out.
    """
    dates = date_ranks(df)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    windows = dates.withColumn("_n", n).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("seq", F.col("t") - F.col("step"))
    windows = windows.where((F.col("seq") >= 0) & (F.col("seq") < F.col("_n") - length)).select("date", "seq", "step")
    return df.join(windows, "date").withColumn("is_target", F.col("step") == length - 1)


def score(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], out: str = "prediction") -> DataFrame:
    """Add a user's model output, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: predict(b)})

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` double")


def score_sequences(windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], channels: Sequence[str], grid: Grid = Grid(res=0.25), length: int = 3, batch: int = 8, out: str = "prediction") -> DataFrame:
    """``seq, date, lat_idx, lon_idx, <out>``: a user's grid model on every window of ``sequences``, for the cells observed in its last step.

    ``predict`` gets up to ``batch`` windows as a dense array (window, step, channel, latitude, longitude), absent cells 0, and returns (window, latitude, longitude). A window's rows
    meet in one task, sorted, so a task holds ``batch`` dense windows at a time, whose size the grid gives, whatever the number of windows.
    """
    shape = (batch, length, len(channels), grid.n_lat, grid.n_lon)
    names = ["seq", "date", *K, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, seen = np.zeros(shape), np.zeros((batch, *shape[3:]), dtype=bool)
        ids: list[int] = []
        dates: list = []

        def scored() -> pa.RecordBatch:
            n = len(ids)
            which, lat, lon = np.nonzero(seen[:n])
            value = np.asarray(predict(dense[:n]), dtype=float)[which, lat, lon]
            columns = [pa.array(np.array(ids)[which]), pa.array(dates, pa.date32()).take(pa.array(which)), pa.array(lat.astype(np.int32)), pa.array(lon.astype(np.int32)), pa.array(value)]
            dense[:n], seen[:n] = 0, False
            ids.clear()
            dates.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            seq, step, lat, lon = (b.column(c).to_numpy() for c in ("seq", "step", *K))
            mark, values = b.column("_mark").to_numpy(zero_copy_only=False), [b.column(f"_c{i}").to_numpy() for i in range(len(channels))]
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1]))) if len(seq) else []
            for a, z in zip(starts, [*starts[1:], len(seq)]):
                if not ids or ids[-1] != seq[a]:
                    if len(ids) == batch:
                        yield scored()
                    ids.append(int(seq[a]))
                    dates.append(None)
                at = len(ids) - 1
                for i, v in enumerate(values):
                    dense[at, step[a:z], i, lat[a:z], lon[a:z]] = v[a:z]
                seen[at, lat[a:z][mark[a:z]], lon[a:z][mark[a:z]]] = True
                last = np.flatnonzero(step[a:z] == length - 1)
                if len(last):
                    dates[at] = b.column("date")[int(a + last[0])].as_py()
        if ids:
            yield scored()

    mark = F.coalesce(F.col("observed") & F.col("is_target"), F.lit(False)).alias("_mark")
    rows = windows.select(F.col("seq").cast("long"), F.col("step").cast("int"), "date", *(F.col(k).cast("int") for k in K), mark, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_c{i}") for i, c in enumerate(channels)))
    return rows.repartition("seq").sortWithinPartitions("seq").mapInArrow(run, f"seq long, date date, lat_idx int, lon_idx int, `{out}` double")

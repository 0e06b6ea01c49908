"""Incremental ingestion and daily super-observations of arriving soundings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridobs.functions.columns import granule_part
from gridobs.operators.grid import K
from gridobs.operators.qc import no2_pixels
from gridobs.sources import io


def ingest_pixels_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: StructType) -> StreamingQuery:
    """Each new pixel file once: good pixels of the box, dated by their granule name, appended by date; runs until nothing is new. ``io.read_appended`` reads the result.

    A micro-batch is a run of ``out_dir`` named by its number, and counts when its manifest is written; a batch that Spark repeats after a failure replaces what it left or changes nothing.
    """
    pixels = no2_pixels(spark.readStream.schema(schema).parquet(in_dir))
    dated = pixels.withColumns({c: granule_part("filename", c) for c in ("date", "time_start", "time_end")})

    def append(batch: DataFrame, number: int) -> None:
        io.append_run(batch, out_dir, f"batch-{number}", ["date"])

    return dated.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def super_observation_stream(df: DataFrame, delay: str = "2 days") -> DataFrame:
    """Medians and counts per day and cell over a stream with ``time`` and cell columns; rows later than ``delay`` are dropped."""
    day = F.window("time", "1 day")
    out = df.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay).groupBy(day.alias("day"), *K)
    out = out.agg(F.median("xco2").alias("xco2"), F.median("tropomi_no2").alias("tropomi_no2"), F.count("xco2").alias("n_soundings"))
    return out.select(F.to_date("day.start").alias("date"), *K, "xco2", "tropomi_no2", "n_soundings")


def write_super_observations(df: DataFrame, out_dir: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """The daily super-observations of a stream, each written once, when the watermark has passed its day; its state then leaves. Runs until nothing is new.

    A later run with the same checkpoint goes on with the open days. Rows of days already written are dropped; ``late_rows`` counts them.
    """
    out = super_observation_stream(df, delay)
    return out.writeStream.outputMode("append").format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query dropped as later than its watermark, as far as its recent progress tells (input rows summed up by cell before they meet the watermark count as one)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

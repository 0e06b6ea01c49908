"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of every contract here: runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables that the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only where none is named and driver and tasks share one machine (tests); elsewhere that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridobs-checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, in the folder that the cluster names."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def rank_in_group(df: DataFrame, group: str, spread: list[str], out: str, rows_per_bucket: int = 4096) -> DataFrame:
    """Number the rows of every ``group`` from 0 without gaps, in no particular order.

    A group may hold most rows, so it is numbered in buckets of about ``rows_per_bucket`` rows
    (a hash of ``spread``): row number inside the bucket plus the size of the buckets before it.
    ``df`` is read twice and has to be stable (a table or a checkpoint). Rows that agree in all of
    ``spread`` are interchangeable.
    """
    from pyspark.sql import Window as W

    n_buckets = max(1, -(-df.count() // rows_per_bucket))
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(n_buckets)))
    sizes = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_b"),
        (F.sum("_n").over(W.partitionBy(group).orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    inside = rows.withColumn("_row", F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*spread)) - 1)
    return (
        inside.join(before, (inside[group] == before["_group"]) & (inside["_bucket"] == before["_b"]))
        .withColumn(out, (F.col("_row") + F.col("_before")).cast("long"))
        .drop("_bucket", "_row", "_group", "_b", "_before")
    )


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, ways: int = 64, hottest: int = 1000) -> DataFrame:
    """Inner join on ``key`` that deals hot keys of ``left`` over ``ways`` tasks by a hash of ``by``; ``right`` gives each of them to all of these tasks.

    A key is hot if it has at least one in ``hottest`` of the rows, so there are at most ``hottest`` of them, whatever the size of the tables. ``left`` is read twice and has to be stable.
    """
    total = left.count()
    hot = left.groupBy(F.col(key).alias("_hot")).count().where(F.col("count") >= max(2 * ways, -(-total // hottest))).select("_hot")
    hot = F.broadcast(hot)
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_way", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(ways))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copied = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_way", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [key, "_way"]).drop("_way")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

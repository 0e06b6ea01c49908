"""The corpus pipeline: drop toxic and poor documents, keep one of each group of near duplicates, pack the rest.

Each stage gets the rows that the stage before it kept, as Parquet read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridobs.llm import jaccard, packing, quality, toxicity
from gridobs.llm._shared import checkpoint_dir, remove, table


def _apart(docs: DataFrame) -> DataFrame:
    """Id, text and all other columns in a struct, so that none of them can clash with a column that an operator adds."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("_whole"))


def _together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_whole.`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (operator 5), fitted on their labels, scores below its threshold.

    A null or empty text has the score of the bias alone. Repeated rows share their fate; other columns pass as they are; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return _together(toxicity.score(_apart(docs), model).where(F.col("score") < toxicity.REJECT), docs)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (operator 2) keep; the target is the rows labelled good, the corpus is all rows.

    A null, empty or blank text has fewer than ten words and goes. Repeated rows share their fate; other columns pass as they are; an empty table stays empty.
    """
    weights = quality.bucket_weights(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return _together(quality.keep(quality.judge(_apart(docs), weights)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8 or more (operator 8).

    Rows are chosen, not ids: the smallest doc_id stays (a null id only if the group has no other), of several texts under it one. A text without words is in no
    group. Rows with the same id and text are one row, whatever their other columns. An empty table stays empty.
    """
    found = jaccard.grouped(docs, jaccard.Rule(width=5, percent=80))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    keep = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(order).alias("_first")).select(F.col("_first.row_key").alias("_kept"))
    keep = keep.union(found.where("comp IS NULL").select("row_key")).distinct()
    rows = _apart(docs).withColumn("_key", jaccard.row_key()).dropDuplicates(["_key"])
    return _together(rows.join(keep, F.col("_key") == F.col("_kept"), "left_semi"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents in sequences of 1024 tokens (operator 9). A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("n-gram Jaccard join", drop_near_duplicates), ("best-fit packing", pack)]

#: Toxicity, hashed ratios and token ids are beyond SQL; tests/llm checks the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage keeps is written below the checkpoint folder and removed when the next stage has read it; the last one's rows stay there."""
    docs = table(spark, sf_dir, "documents")
    shared = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
        if k:
            remove(spark, f"{shared}/{k - 1}")
    return docs

"""Quality rules and a hashed n-gram likelihood ratio, with DataFrame functions only.

Words and word pairs of every text are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are counted over all
rows: the raw corpus, and the trusted target (rows labelled good). A text's verdict is its mean log-likelihood ratio per n-gram against a fixed threshold; plain
rules on the same words reject texts that are too short or repeat themselves. Each row is judged inside itself; only bucket counts are shuffled.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SMOOTHING, THRESHOLD, SYMBOLS, BLANKS = 1 << 16, 20.0, -0.15, "#*$%&|<>", " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text in order: runs of anything but ASCII blanks; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " +"), "")


def with_hashes(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_w``: the 64-bit hash of each word."""
    return df.withColumn("_w", F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))


def buckets(hashes: Column, n_buckets: int = BUCKETS) -> Column:
    """Buckets of all words, then of all pairs of neighbouring words."""
    one = F.transform(hashes, lambda w: F.pmod(w, F.lit(n_buckets)).cast("int"))
    two = F.zip_with(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n_buckets)).cast("int"),
    )
    return F.concat(one, two)


def bucket_weights(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS) -> list[float]:
    """Log-likelihood ratio of each bucket, target against raw; counts are over all rows.

    Both counts get ``SMOOTHING`` n-grams in the target's share, so a bucket of few n-grams, which is as likely absent from
    the target by chance, says little.

    ``trusted`` holds the ids of the target rows. Without any target row all weights are 0.
    """
    good = trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_good")).distinct()
    flagged = (
        df.select(id_col, text_col).join(good.hint("shuffle_hash"), F.col(id_col) == F.col("_good"), "left")  # the same plan at every size; texts stream past the ids, unsorted
        .select(F.col(text_col).alias("_t"), F.col("_good").isNotNull().cast("long").alias("_trusted"))
    )
    per_row = with_hashes(flagged, "_t").select("_trusted", F.explode(buckets(F.col("_w"), n_buckets)).alias("bucket"))
    found = per_row.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_trusted").alias("target")).collect()
    raw, target = [0] * n_buckets, [0] * n_buckets
    for r in found:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not sum(target):
        return [0.0] * n_buckets
    share = sum(target) / sum(raw)
    return [math.log((t + SMOOTHING * share) / (r + SMOOTHING)) - math.log(share) for t, r in zip(target, raw)]


def judge(df: DataFrame, weights: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``df`` and the rule columns, the mean ratio ``llr`` and ``kept``; columns of these names are replaced.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed`` and ``kept`` (boolean). A null or empty text
    has no words and fails. Repeated rows are judged alike; an empty table stays empty.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    rows = with_hashes(df.drop(*(set(df.columns) & set(added))), text_col).withColumn("n_words", F.size("_w").cast("long"))
    rows = rows.withColumn(
        "_windows",
        F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 4, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get("_w", i + k) for k in range(1, 5)))),
    ).withColumn("_lines", lines).withColumn("_grams", buckets(F.col("_w"), len(weights)))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.transform("_sorted", lambda s, i: F.when((s["h"] == F.get("_sorted", i - 1)["h"]) | (s["h"] == F.get("_sorted", i + 1)["h"]), s["i"])),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("_twice", F.sort_array(twice))
    covered = F.aggregate(
        F.transform("_twice", lambda x, i: F.least(F.lit(5), F.coalesce(F.get("_twice", i + 1), x + 5) - x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    rows = (
        rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .withColumn("word_chars", F.length(F.translate(text, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("llr", F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(F.size("_grams"), F.lit(1)))
        .withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    )
    return rows.select(*(c for c in df.columns if c not in added), *added)


def keep(judged: DataFrame) -> DataFrame:
    """The kept rows. The row number ties the filter to the rows as judged: without it the optimiser copies the nested array
    expressions behind ``kept`` into the filter, once for every use, and the work grows exponentially."""
    return judged.withColumn("_row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_row") >= 0)).drop("_row")

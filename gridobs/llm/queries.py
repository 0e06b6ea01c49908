"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridobs.llm import ann, chat, decontaminate, html, jaccard, lengths, negatives, packing, quality, runs, sentencepieces, sharding, toxicity
from gridobs.llm._shared import table

N_SHARDS = 8


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), decoded=True).drop("decoded")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.bucket_weights(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality.judge(docs, weights).drop("text")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_tricky(table(spark, sf_dir, "conversations"))))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.score(docs, model).select(
        "doc_id", (~toxicity.learnable()).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted")
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Rule(width=3, percent=90))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limit_table(lengths.length_histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents"))))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


def _with_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: every tenth document, by a hash of its id, repeats a stretch of its words from word ``a`` on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, quality.words(F.col("text"))).alias("_w"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_n", F.size("_w").cast("long")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")).withColumn("_a", F.col("_a").cast("int"))
    rest = F.col("_n").cast("int") - F.col("_a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_periods(table(spark, sf_dir, "documents"))).withColumn("best", runs.strongest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.quantised(table(spark, sf_dir, "embeddings").withColumn("label", label)), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sentencepiece, op2_quality_rules, op3_chat_formatting, op4_sharding, op5_toxicity, op6_html_extraction, op7_nearest_neighbours, op8_jaccard_join,
            op9_best_fit_packing, op10_token_counts, op11_decontamination, op12_periodic_runs, op13_hard_negatives,
        )
    }


_OP3 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES
    (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'),
    (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '\### Assistant: </turn> ok')) AS v(conv_id, turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g'))) AS BIGINT) AS formatted_chars,
       false AS rewrites_history
FROM rows GROUP BY conv_id
"""

_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), reach(doc_id, other) AS (
  SELECT a, a FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS said
  FROM (SELECT *, CAST(least(10, len(words)) AS INT) AS n FROM b WHERE len(words) > 0)
), lengths AS (SELECT DISTINCT n FROM w),
s AS (
  SELECT row, n, unnest(range(1, len(words) - n + 2)) AS pos, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS said
  FROM d JOIN lengths ON len(words) >= n
), hits AS (SELECT s.row, s.pos, s.n, w.item_id FROM s JOIN w ON s.said = w.said AND s.n = w.n),
covered AS (SELECT row, count(DISTINCT i) AS n_hit FROM (SELECT row, unnest(range(pos, pos + n)) AS i FROM (SELECT DISTINCT row, pos, n FROM hits)) GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

_OP13 = """
WITH one AS (
  SELECT vec_id, min(struct_pack(label := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
                                 vec := list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)))) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), e AS (SELECT vec_id, r.label AS label, r.vec AS vec FROM one),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: a.vec[i] * c.vec[i])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), good AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT g.anchor_id, g.positive_id, CAST(row_number() OVER (PARTITION BY g.anchor_id, g.positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank,
       s.other AS negative_id, g.positive_score, s.score AS negative_score
FROM good g JOIN scores s ON s.anchor_id = g.anchor_id AND NOT s.same
WHERE 80 * g.positive_score <= 100 * s.score AND 100 * s.score <= 100 * g.positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": _OP3, "op8_jaccard_join": _OP8, "op11_decontamination": _OP11, "op13_hard_negatives": _OP13}

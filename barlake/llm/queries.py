"""The registered queries of this package: thin contracts around its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    pages = extract(table(spark, sf_dir, "pages"), text_col="__text", length_col="n_chars")
    return pages.select("page_id", "url", F.col("__text").alias("text"), "n_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), score_col="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), score_col="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    docs = table(spark, sf_dir, "documents")
    crc = docs.withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))
    return shard_by_bytes(crc, 24).select(
        "doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95).withColumnRenamed("id", "vec_id")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10).withColumnRenamed("id", "vec_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
    )


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('17' || COALESCE(':' || CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, SUM(size)::BIGINT AS total FROM sized GROUP BY source),
weighed AS (
  SELECT source, total, CAST((ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, total * 3 AS cap FROM totals),
levels AS (
  SELECT *, CAST(SUM(total) OVER () - COALESCE(SUM(cap) OVER b, 0) AS DOUBLE) / (SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0)) AS lv
  FROM weighed WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, total, LEAST(CAST(cap AS DOUBLE), MAX(lv) OVER () * w) AS target FROM levels),
plan AS (
  SELECT *, LEAST(CAST(FLOOR(target + 1e-6) AS BIGINT), total * 3) AS budget FROM targets),
placed AS (
  SELECT s.*, p.total, p.target, p.budget, CASE WHEN p.total > 0 THEN p.budget // p.total ELSE 0 END AS epochs,
         CAST(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target,
       CAST(epochs * size + GREATEST(0, LEAST(size, budget - epochs * total - (e - size))) AS BIGINT) AS taken
FROM placed
"""


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def queries() -> dict:
    return {
        "op1_main_text": op1_main_text,
        "op2_toxicity": op2_toxicity,
        "op7_quality": op7_quality,
        "op3_near_vectors": op3_near_vectors,
        "op8_neighbours": op8_neighbours,
        "op4_histogram_sort": op4_histogram_sort,
        "op5_jaccard": op5_jaccard,
        "op6_bpe": op6_bpe,
        "op9_mixing": op9_mixing,
        "op10_repeats": op10_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9_SQL}

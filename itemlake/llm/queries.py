"""The numbered queries over the driver's tables, each a thin use of its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.llm import bpe, decontaminate, linededup, lm, neardup, passages, pii, tokencount, topk, toxicity
from itemlake.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its base spans by kind and their digest, and all spans with those that contexts add."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def count(i: int, kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *(count(i, kind) for i, kind in enumerate(pii.KINDS)),
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(F.filter("added", lambda s: s["kind"] == len(pii.KINDS))).cast("long").alias("n_secret"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many stay, and the digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    left = linededup.dedup_lines(docs)
    n_kept = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    return left.select("doc_id", "n_lines", n_kept.alias("n_kept"), F.sha2("text", 256).alias("text_sha256"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its shingles, its group of near duplicates, and whether it is the one that stays."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the digests of its ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode_documents(encoded, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "similarity")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its UTF-8 bytes and tokens, and whether it exceeds 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document a toxicity score, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words and their masked log-likelihood, in sum and on average."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.train(docs)).drop("text")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that two documents share, by words."""
    return passages.repeated_passages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x : CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Scores from here on count as toxic.
TOXIC = 0.3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_topk_search": op9_topk_search,
    "op10_substring_dedup": op10_substring_dedup,
}

#: Queries that DuckDB can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op9_topk_search": OP9_SQL}

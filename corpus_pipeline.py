"""A training corpus from raw documents: five stages, each one operator over all that the last one kept.

Every stage but the last returns the columns of documents. Rows with null or
empty texts pass all filters; extra columns pass through; an empty table stays
empty. Rows of one id are told apart by their text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.llm import bpe, decontaminate, linededup, neardup, toxicity
from itemlake.llm.common import apart, table, written
from itemlake.llm.queries import TOXIC


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that do not score as toxic; the model learns from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    out = apart(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs, labels), out=out)
    return scored.filter(F.col(out) < TOXIC).drop(out)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that are near copies of an earlier one; n_chars follows the text."""
    left = linededup.dedup_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of near duplicates, and every row that is in none.

    Null ids come last, and of one id the smallest hash of a text first.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"))
    found = neardup.near_duplicates(docs.select(row.alias("doc_id"), "text")).filter(F.col("id") != F.col("component"))
    one, text = apart(docs, "id"), apart(docs, "text_hash")
    gone = found.select(F.col("id.doc_id").alias(one), F.col("id.text").alias(text)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(one)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row the token ids, and whether they decode to the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode_documents(encoded, path, public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: A trained model decides the first stage, which SQL cannot express; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The item: one row of a fixed envelope around a schemaless payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_STATE = "default"
OVERHEAD = 256  # bytes of an item beside its strings and content: a stated constant


def content_type(text: Column) -> Column:
    """json if the text starts as an object, array or string and parses, else binary."""
    head = F.substring(F.ltrim(F.translate(text, "\t\n\f\r", "    ")), 1, 1)
    return F.when(head.isin("{", "[", '"') & F.try_parse_json(text).isNotNull(), "json").otherwise("binary")


def items(df: DataFrame, object_id: Column, payload: Column, version: Column, updated_at: Column, state: Column | None = None, detect: bool = False) -> DataFrame:
    """Items of the rows of df; payload is JSON text unless its type is to be detected."""
    kind = content_type(payload) if detect else F.lit("json")
    return df.select(
        object_id.alias("object_id"),
        version.cast("long").alias("version"),
        updated_at.cast("long").alias("updated_at"),
        kind.alias("content_type"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("content_hash"),
        F.coalesce(state, F.lit(DEFAULT_STATE)).alias("state") if state is not None else F.lit(DEFAULT_STATE).alias("state"),
    )


def size_bytes(item: DataFrame) -> Column:
    return F.lit(OVERHEAD) + F.octet_length("object_id") + F.octet_length("payload") + F.octet_length("content_hash")


def verified(item: DataFrame) -> DataFrame:
    """Items with ok: whether the payload still has its recorded hash."""
    return item.withColumn("ok", F.sha2("payload", 256).eqNullSafe(F.col("content_hash")))

"""Item views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.model import items


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def geo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as crm.<region>.<nation>.<key>; the market segment is the state."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    # nations are a fixed list of a few dozen
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    object_id = F.concat(F.lit("crm."), _slug(F.col("r_name")), F.lit("."), _slug(F.col("n_name")), F.lit("."), F.col("c_custkey").cast("string"))
    payload = F.concat(F.lit('{"name":"'), "c_name", F.lit('","key":'), F.col("c_custkey").cast("string"), F.lit("}"))
    return items(c, object_id, payload, 1 + F.col("c_custkey") % 3, F.col("c_custkey") * 1000, F.lower("c_mktsegment"))


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as crdt:docs:<id>, with their labels where they have any."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    payload = F.to_json(F.struct("text", "lang", "source", "n_chars", F.array("lang", "source").alias("tags"), "quality", (F.col("toxic") == 1).alias("toxic")))
    return items(d, F.concat(F.lit("crdt:docs:"), F.col("doc_id").cast("string")), payload, 1 + F.col("doc_id") % 3, F.col("doc_id") * 1000)


def vec_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vec:<label>:<id>, with the vector beside the payload."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("vec:"), F.col("label").cast("string"), F.lit(":"), F.col("vec_id").cast("string")).alias("object_id"), F.to_json(F.struct("label", "vec_id")).alias("payload"), F.col("embedding").alias("vector"))


def event_log_of(e: DataFrame) -> DataFrame:
    """Events as a change log: seq, op (errors delete), key user.<id>.<slot>, payload, time in ms."""
    key = F.concat(F.lit("user."), F.col("user_id").cast("string"), F.lit("."), (F.col("event_id") % 3).cast("string"))
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "DEL").otherwise("PUT").alias("op"),
        key.alias("object_id"),
        F.col("props").alias("payload"),
        F.sha2("props", 256).alias("content_hash"),
        ms.alias("updated_at"),
        "user_id",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log_of(table(spark, sf_dir, "events"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as conv.<id>.<turn>; the role is the state."""
    t = table(spark, sf_dir, "conversations")
    object_id = F.concat(F.lit("conv."), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    return items(t, object_id, F.to_json(F.struct("role", "text")), F.lit(1), F.col("turn"), F.col("role"))

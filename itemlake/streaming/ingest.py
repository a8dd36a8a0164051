"""Micro-batched ingestion of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.operators.store import latest


def append_batches(changes: DataFrame, log_path: str, checkpoint: str) -> None:
    """Append a stream of changes to a Parquet log, all that is there now, and return when done.

    Each micro-batch keeps the last change of an id, as an upsert would; a
    batch that is run again after a failure writes the same folder again.
    """

    def flush(batch: DataFrame, number: int) -> None:
        latest(batch, "object_id").write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    changes.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, log_path: str) -> DataFrame:
    """The state that the log leads to: the latest change of each id, without deleted ones."""
    return latest(spark.read.parquet(log_path).drop("batch"), "object_id").filter(F.col("op") == "PUT")

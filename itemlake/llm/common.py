"""What the corpus operators share: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SWEEP = 3  # tables from one collection of the driver's garbage to the next
SMALL = 32 << 20  # bytes of a table that is broadcast
BITS, MOST_BITS = 16, 1 << 26  # bits for each key that is sought, and of all at most
WORD_BITS, CHUNK = 6, 10  # log2 of the bits of a word, and of the words of a chunk

_written: dict[str, SparkSession] = {}
_since = 0
_scopes = threading.local()  # open scopes of this thread, the paths of the tables made in each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    A local master (tests) may leave it unset and gets a temporary folder;
    on a cluster an unset folder is an error, as no local one would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return spark.conf.get("spark.checkpoint.dir")


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound this session's Arrow batches by bytes as well as rows: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def _bytes(df: DataFrame) -> int:
    """The bytes of df in memory, about: one aggregation, of which one row comes back.

    A row counts as its fixed columns, the texts in it and the elements of its
    arrays, and what a hash table adds.
    """
    width = F.lit(32)
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind == "array":
            width = width + 16 * F.coalesce(F.array_size(field.name), F.lit(0))
        else:
            width = width + 16
    return df.agg(F.sum(width.cast("long")).alias("bytes")).first().bytes or 0


def small(df: DataFrame) -> DataFrame:
    """df marked for a broadcast if it is measured to have at most SMALL bytes, else as it is."""
    return F.broadcast(df) if _bytes(df) <= SMALL else df


def _marked(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with a column that is false only where the key is none of `keys` (one column of longs).

    The keys' hashes are set bits of a broadcast table of at most MOST_BITS. As long as that has BITS
    for each key, one in so many of the other rows is true as well; with more keys, more of them.
    """
    n, bits = keys.count(), 1 << (WORD_BITS + CHUNK)
    while bits < min(BITS * n, MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(29)), F.lit(bits))
    at = keys.select(place(F.col(keys.columns[0])).alias("at"))
    bit = F.expr(f"shiftleft(1L, cast(at % {1 << WORD_BITS} as int))")
    every = keys.sparkSession.range(bits >> WORD_BITS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = at.select(F.shiftright("at", WORD_BITS).alias("word"), bit.alias("bit")).union(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    held, chunk, where = apart(rows, "words"), apart(rows, "chunk"), apart(rows, "at")
    chunks = words.groupBy(F.shiftright("word", CHUNK).alias(chunk)).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    chunks = chunks.select(chunk, F.transform("w", lambda x: x["bits"]).alias(held))
    word = F.get(held, F.shiftright(where, WORD_BITS).cast("int") % (1 << CHUNK))
    both = rows.withColumn(where, place(key)).withColumn(chunk, F.shiftright(where, WORD_BITS + CHUNK)).join(F.broadcast(chunks), chunk)
    hit = F.call_function("shiftrightunsigned", word, (F.col(where) % (1 << WORD_BITS)).cast("int")) % 2 != 0
    return both.withColumn(name, hit).drop(where, chunk, held)


def sought(rows: DataFrame, needed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with the table `needed` (inner, left_semi or left) without shuffling many rows that find nothing there.

    A small table is broadcast. Of a larger one the bits of its keys are, and the rows without a bit
    take no part in the join, which is as exact.
    """
    if _bytes(needed) <= SMALL:
        return rows.join(F.broadcast(needed), on, how)
    mark = apart(rows, "mark")
    marked = _marked(rows, F.xxhash64(*on), needed.select(F.xxhash64(*on).alias("key")), mark)
    met = marked.filter(mark).drop(mark).join(needed, on, how)
    return met if how != "left" else met.unionByName(marked.filter(~F.col(mark)).drop(mark), allowMissingColumns=True)


def among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows whose key is one of `keys` (one column of longs), and a few others if these are many."""
    own = apart(rows, "key")
    if _bytes(keys) <= SMALL:
        return rows.join(F.broadcast(keys.select(F.col(keys.columns[0]).alias(own)).distinct()), key == F.col(own), "left_semi")
    mark = apart(rows, "mark")
    return _marked(rows, key, keys, mark).filter(mark).drop(mark)


def apart(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame | Iterable[DataFrame], name: str, heavy: bool = False) -> DataFrame:
    """df, or the rows of several made one after the other, as a Parquet table in the shared folder, read again.

    Later stages read the table, so a lost executor costs one rereading and
    not the lineage. Tables go when the session ends, or earlier by drop().
    What each of several, or a heavy one, has shuffled goes at once.
    """
    several = not isinstance(df, DataFrame)
    path = None
    for one in df if several else [df]:
        spark, schema = one.sparkSession, one.schema
        path = path or _new_path(spark, name)
        one.write.mode("append").parquet(path)
        del one
        _sweep(spark, heavy or several)
    return _read(spark, schema, path)


def dealt(df: DataFrame, column: str, parts: int, name: str) -> list[DataFrame]:
    """df written as so many tables, by the hash of a column; those that would be empty are left out."""
    spark, part = df.sparkSession, apart(df, "part")
    path = _new_path(spark, name)
    df.withColumn(part, F.pmod(F.xxhash64(column, F.lit(31)), F.lit(parts)).cast("int")).write.partitionBy(part).parquet(path)
    _sweep(spark, True)
    return [_read(spark, df.schema, at) for i in range(parts) if _exists(spark, at := f"{path}/{part}={i}")]


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/itemlake/{name}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    _written[path] = spark
    if _open_scopes():
        _open_scopes()[-1].append(path)
    out = spark.read.schema(schema).parquet(path)
    out._itemlake_path = path
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _sweep(spark: SparkSession, now: bool) -> None:
    """Have the driver collect its garbage now and then, or now.

    Shuffle files and broadcasts go when their plans are collected, which a driver
    with room left does not do for long; until then they fill the executors' disks.
    """
    global _since
    _since += 1
    if now or _since >= SWEEP:
        _since = 0
        spark._jvm.System.gc()


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread makes by written() inside go at the end, but those passed to the function that this gives.

    What is kept belongs to the scope around, if there is one. Nothing that is read later may read other tables.
    """
    made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._itemlake_path)
        return df

    _open_scopes().append(made)
    try:
        yield keep
    finally:
        _open_scopes().pop()
        for path in made:
            if path not in kept:
                _delete(path)
            elif _open_scopes():
                _open_scopes()[-1].append(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        _delete(df._itemlake_path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone; the folder's owner clears what is left
            _written.pop(path, None)

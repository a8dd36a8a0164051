"""Operators on items and change logs; each returns the new state or rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The last row of each key: a partial maximum, so hot keys don't meet in one task."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base with the changes' rows in place of those of their ids; dirty if new, or the hash or version differs.

    Of several changes of an id the last by `seq` counts, or without that column the one of the highest version.
    """
    changes = latest(changes, "object_id", order="seq" if "seq" in changes.columns else "version")
    old = base.select("object_id", F.struct(*[c for c in base.columns if c != "object_id"]).alias("old"))
    new = changes.select("object_id", F.struct(*[c for c in changes.columns if c != "object_id"]).alias("new"))
    both = old.join(new, "object_id", "full")
    same = F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")) & F.col("old.version").eqNullSafe(F.col("new.version"))
    dirty = F.col("new").isNotNull() & (F.col("old").isNull() | ~same)
    cols = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in base.columns if c != "object_id"]
    return both.select("object_id", *cols, dirty.alias("merkle_dirty"))


def get_many(items: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (pos, object_id) with their items, nulls where there is none."""
    return ids.join(items, "object_id", "left")


def delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids, "object_id", "left_anti")


def delete_prefix(items: DataFrame, prefix: str) -> DataFrame:
    return items.filter(~F.startswith("object_id", F.lit(prefix)))


def delete_state(items: DataFrame, state: str) -> DataFrame:
    return items.filter(~F.col("state").eqNullSafe(F.lit(state)))


def set_state(items: DataFrame, where: Column, state: str) -> DataFrame:
    return items.withColumn("state", F.when(where, F.lit(state)).otherwise(F.col("state")))


def scan_prefix(items: DataFrame, prefix: str, limit: int) -> DataFrame:
    return items.filter(F.startswith("object_id", F.lit(prefix))).orderBy("object_id").limit(limit)


def scan_page(items: DataFrame, offset: int, limit: int) -> DataFrame:
    return items.orderBy("object_id").offset(offset).limit(limit)


def scan_oldest(items: DataFrame, limit: int) -> DataFrame:
    return items.orderBy("updated_at", "object_id").limit(limit)


def exists(items: DataFrame, ids: DataFrame) -> DataFrame:
    """ids with `found`."""
    return ids.join(items.select("object_id", F.lit(True).alias("found")).distinct(), "object_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def missing(items: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(items, "object_id", "left_anti")


def is_current(items: DataFrame, known: DataFrame) -> DataFrame:
    """known (object_id, known_hash) with `current`."""
    held = items.select("object_id", F.col("content_hash").alias("known_hash"), F.lit(True).alias("held")).distinct()
    joined = known.join(held, ["object_id", "known_hash"], "left")
    return joined.select("object_id", F.coalesce("held", F.lit(False)).alias("current"))


def status(hot: DataFrame, archive: DataFrame) -> DataFrame:
    """Where each id is held."""
    sides = [d.select("object_id", F.lit(True).alias(n)) for d, n in ((hot, "in_hot"), (archive, "in_archive"))]
    return sides[0].join(sides[1], "object_id", "full").select("object_id", F.coalesce("in_hot", F.lit(False)).alias("in_hot"), F.coalesce("in_archive", F.lit(False)).alias("in_archive"))


def in_state(items: DataFrame, state: str) -> DataFrame:
    return items.filter(F.col("state") == state)


def state_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("state").agg(F.count("*").alias("n"))


def prefix_counts(items: DataFrame, segments: int) -> DataFrame:
    """Items by the first so many segments of their ids."""
    return items.groupBy(F.substring_index("object_id", ".", segments).alias("prefix")).agg(F.count("*").alias("n"))


def dirty(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose hash tree entry is out of date, by id if limited."""
    found = items.filter("merkle_dirty")
    return found if limit is None else found.orderBy("object_id").limit(limit)


def mark_clean(items: DataFrame, ids: DataFrame) -> DataFrame:
    """items with the dirty flag of these ids taken away."""
    joined = items.join(ids.select("object_id", F.lit(True).alias("_cleaned")).distinct(), "object_id", "left")
    return joined.withColumn("merkle_dirty", F.col("merkle_dirty") & F.col("_cleaned").isNull()).drop("_cleaned").select(*items.columns)


def get_or_insert(items: DataFrame, asked: DataFrame) -> DataFrame:
    """items with those asked-for rows (of the same columns) whose ids it lacks."""
    return items.unionByName(latest(asked, "object_id", order="version").join(items, "object_id", "left_anti"))


def tiered(hot: DataFrame, archive: DataFrame, now: Column) -> DataFrame:
    """Each id from the first tier that has it: hot rows (with expires_at, null for never) before they expire, else the archive's; tier tells which."""
    live = hot.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).drop("expires_at")
    rest = archive.join(live.select("object_id"), "object_id", "left_anti")
    return live.withColumn("tier", F.lit("hot")).unionByName(rest.withColumn("tier", F.lit("archive")))


def route(key: Column, prefixes: dict[str, str], default: str = "sync_items") -> Column:
    """The route of the longest prefix that a key has."""
    out = F
    for prefix in sorted(prefixes, key=len, reverse=True):
        out = out.when(F.startswith(key, F.lit(prefix)), F.lit(prefixes[prefix]))
    return out.otherwise(F.lit(default)) if prefixes else F.lit(default)


def trimmed(log: DataFrame, newest: int) -> DataFrame:
    """The newest rows of a log, by seq."""
    return log.orderBy(F.desc("seq")).limit(newest)


def cdc_log(log: DataFrame) -> DataFrame:
    """Change entries: PUT with hash and meta, DEL with the key alone."""
    put = F.col("op") == "PUT"
    return log.select("seq", "op", F.col("object_id").alias("key"), F.when(put, F.col("content_hash")).alias("hash"), F.when(put, F.col("payload")).alias("data"), F.when(put, F.col("updated_at")).alias("updated_at"))


def apply_cdc(entries: DataFrame) -> DataFrame:
    """The state that a log of change entries leads to."""
    return latest(entries, "key").filter(F.col("op") == "PUT").select("key", "seq", "hash", "updated_at")


def emitted(before: DataFrame, after: DataFrame) -> DataFrame:
    """The change entries (op, key, hash, version, content_type, updated_at) between two states: nothing for rows of equal content."""
    cols = ("content_hash", "version", "content_type", "updated_at")
    old = before.select("object_id", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    new = after.select("object_id", *cols, F.lit(True).alias("is"))
    changed = old.join(new, "object_id", "full").filter(F.col("is").isNull() | F.col("was").isNull() | ~F.col("old").eqNullSafe(F.col("content_hash")))
    op = F.when(F.col("is"), "PUT").otherwise("DEL")
    return changed.select(op.alias("op"), F.col("object_id").alias("key"), F.col("content_hash").alias("hash"), *cols[1:])


def applied(base: DataFrame, entries: DataFrame) -> DataFrame:
    """base (object_id, content_hash, version, ...) after entries, one of a key: those of the held hash change nothing; others take the entry's meta."""
    names = {"content_hash": "hash", "version": "version", "content_type": "content_type", "updated_at": "updated_at"}
    both = base.withColumn("held", F.lit(True)).join(entries.select(F.col("key").alias("object_id"), F.struct("op", *names.values()).alias("e")), "object_id", "full")
    takes = (F.col("e.op") == "PUT") & ~(F.coalesce("held", F.lit(False)) & F.col("content_hash").eqNullSafe(F.col("e.hash")))
    cols = [F.when(takes, F.col(f"e.{e}")).otherwise(F.col(c)).alias(c) for c, e in names.items()]
    return both.filter(~(F.coalesce("e.op", F.lit("PUT")) == "DEL")).select("object_id", *cols, F.coalesce(takes, F.lit(False)).alias("changed"))


def write_routed(items: DataFrame, prefixes: dict[str, str], path: str) -> DataFrame:
    """Write items into a folder for each route; (route, n_written, n_verified), as read back."""
    items.withColumn("route", route(F.col("object_id"), prefixes)).write.partitionBy("route").parquet(path)
    held = items.sparkSession.read.parquet(path)
    ok = F.sha2("payload", 256).eqNullSafe(F.col("content_hash"))
    return held.groupBy("route").agg(F.count("*").alias("n_written"), F.count_if(ok).alias("n_verified"))


def split_flush(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last row of each id, by where its options (to_hot, to_archive) send it: the hot rows and the archive's."""
    last = latest(batch, "object_id")
    return last.filter("to_hot"), last.filter("to_archive")


def without_state(items: DataFrame, where: Column, default: str = "default") -> DataFrame:
    """items with those of a condition put back to the default state."""
    return set_state(items, where, default)


def branches(items: DataFrame, segments: int) -> DataFrame:
    """Items and dirty ones by the first so many segments of their ids; clean if none is dirty."""
    prefix = F.substring_index("object_id", ".", segments).alias("branch")
    return items.groupBy(prefix).agg(F.count("*").alias("n"), F.count_if("merkle_dirty").alias("n_dirty"), (F.count_if("merkle_dirty") == 0).alias("clean"))


def within_limit(items: DataFrame, most: int) -> DataFrame:
    """items with accepted: whether the payload has at most so many bytes (null: none)."""
    return items.withColumn("accepted", F.coalesce(F.octet_length("payload"), F.lit(0)) <= most)


def compact(log: DataFrame, path: str) -> None:
    """Write the latest rows of a log, dealt by key so that later upserts prune."""
    latest(log, "object_id").repartition("object_id").write.mode("overwrite").parquet(path)

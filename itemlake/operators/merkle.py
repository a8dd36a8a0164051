"""Hash trees over dotted ids, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.functions.paths import ancestors, interior_hash, last_segment, leaf_hash, parent, segments
from itemlake.sources.shared import written


def leaves(items: DataFrame) -> DataFrame:
    """(path, hash) of items."""
    return items.select(F.col("object_id").alias("path"), leaf_hash(F.col("object_id"), F.col("version"), F.col("content_hash")).alias("hash"))


def build(leaf: DataFrame) -> DataFrame:
    """All nodes (path, parent_path, merkle_hash, object_count, is_leaf, own_hash) of the leaves (path, hash); the root's path is empty.

    An id that has children too takes the hash of its children and keeps its
    leaf's in own_hash, which is null where the path is no id. One action
    finds the depth; each level is one aggregation of the level below, which
    is written, so that a lost executor costs one level.
    """
    leaf = written(leaf.withColumn("depth", F.size(segments(F.col("path")))), "leaves")
    deepest = leaf.agg(F.max("depth")).first()[0] or 0
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        own = leaf.filter(F.col("depth") == depth).select("path", "hash", F.lit(0).cast("long").alias("children"), F.col("hash").alias("own_hash"))
        if levels:
            child = F.struct(last_segment(F.col("path")).alias("segment"), F.col("merkle_hash").alias("hash"))
            made = levels[-1].groupBy(F.col("parent_path").alias("path")).agg(interior_hash(F.collect_list(child)).alias("hash"), F.count("*").alias("children")).withColumn("own_hash", F.lit(None).cast("string"))
            own = own.union(made).groupBy("path").agg(F.max_by("hash", "children").alias("hash"), F.max("children").alias("children"), F.max("own_hash").alias("own_hash"))
        level = own.select("path", F.when(F.col("path") != "", parent(F.col("path"))).alias("parent_path"), F.col("hash").alias("merkle_hash"), F.col("children").alias("object_count"), (F.col("children") == 0).alias("is_leaf"), "own_hash")
        levels.append(written(level, "level"))
    return reduce(DataFrame.union, levels)


def update(nodes: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Nodes after leaves (path, hash) changed and paths were deleted: only branches that hold one are built again."""
    touched = changed.select("path").union(deleted.select("path"))
    branches = touched.select(F.split_part(F.col("path"), F.lit("."), F.lit(1)).alias("branch")).distinct()
    of_branch = nodes.filter("path <> ''").withColumn("branch", F.split_part(F.col("path"), F.lit("."), F.lit(1)))
    kept = of_branch.join(branches, "branch", "left_semi").filter("own_hash is not null").select("path", F.col("own_hash").alias("hash")).join(touched, "path", "left_anti")
    rebuilt = build(kept.union(changed.select("path", "hash"))).filter("path <> ''")
    untouched = of_branch.join(branches, "branch", "left_anti").drop("branch")
    every = untouched.union(rebuilt)
    top = every.filter("parent_path = ''").agg(interior_hash(F.collect_list(F.struct(F.col("path").alias("segment"), F.col("merkle_hash").alias("hash")))).alias("merkle_hash"), F.count("*").alias("object_count"))
    none = F.lit(None).cast("string")
    return every.union(top.filter("object_count > 0").select(F.lit("").alias("path"), none.alias("parent_path"), "merkle_hash", "object_count", F.lit(False).alias("is_leaf"), none.alias("own_hash")))


def diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, kind): nodes that differ, or that one side alone has."""
    a = ours.select("path", F.col("merkle_hash").alias("a"))
    b = theirs.select("path", F.col("merkle_hash").alias("b"))
    kind = F.when(F.col("b").isNull(), "local_only").when(F.col("a").isNull(), "remote_only").otherwise("divergent")
    return a.join(b, "path", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", kind.alias("kind"))


def diff_children(ours: DataFrame, theirs: DataFrame, path: str) -> DataFrame:
    """The children of one node that differ."""
    return diff(*(n.filter(F.col("parent_path") == path) for n in (ours, theirs)))


def drill_down(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, kind): the leaves that differ or are missing on one side, found level by level below unequal nodes alone."""
    sides = [n.select("path", "parent_path", F.struct("merkle_hash", "is_leaf").alias(name)) for n, name in ((ours, "a"), (theirs, "b"))]
    deepest = max(n.agg(F.max(F.size(segments(F.col("path"))))).first()[0] or 0 for n in (ours, theirs))
    found, parents = [], None
    for _ in range(deepest + 1):
        a, b = (s.filter("parent_path is null") if parents is None else s.join(parents, "parent_path", "left_semi") for s in sides)
        both = a.drop("parent_path").join(b.drop("parent_path"), "path", "full").filter(~F.col("a.merkle_hash").eqNullSafe(F.col("b.merkle_hash")))
        unequal = written(both.select("path", F.coalesce("a.is_leaf", F.lit(False)).alias("ours"), F.coalesce("b.is_leaf", F.lit(False)).alias("theirs"), (F.coalesce(~F.col("a.is_leaf"), F.lit(False)) | F.coalesce(~F.col("b.is_leaf"), F.lit(False))).alias("inner")), "unequal")
        found.append(unequal.filter("ours or theirs"))
        parents = unequal.filter("inner").select(F.col("path").alias("parent_path"))
    kind = F.when(F.col("ours") & F.col("theirs"), "divergent").when(F.col("ours"), "local_only").otherwise("remote_only")
    return reduce(DataFrame.union, found).select("path", kind.alias("kind"))


def resync(items: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The items to send for the other side to become like ours: those of leaves that differ or that it lacks."""
    wanted = drill_down(ours, theirs).filter("kind <> 'remote_only'").select(F.col("path").alias("object_id"))
    return items.join(wanted, "object_id", "left_semi")


def roots(*trees: DataFrame) -> DataFrame:
    """(tree, merkle_hash) of the roots, by the trees' order; an empty tree has none."""
    return reduce(DataFrame.union, [t.filter("path = ''").select(F.lit(i).alias("tree"), "merkle_hash") for i, t in enumerate(trees)])


def under(nodes: DataFrame, prefix: str) -> DataFrame:
    """The leaves at a path or below it."""
    return nodes.filter(F.col("is_leaf") & ((F.col("path") == prefix) | F.startswith("path", F.lit(f"{prefix}."))))


def dirty_prefixes(items: DataFrame) -> DataFrame:
    """First segments of dirty ids."""
    return items.filter("merkle_dirty").select(F.split_part(F.col("object_id"), F.lit("."), F.lit(1)).alias("prefix")).distinct()


def affected(paths: DataFrame) -> DataFrame:
    """All prefixes of changed paths, deepest first."""
    return paths.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().orderBy(F.desc(F.size(segments(F.col("path")))), "path")

"""Benchmark items within documents, by SimHash windows, in DataFrame functions alone.

Words are runs of letters, marks and digits in lower case; shingles are
SHINGLE of them, weighted by how often they occur. A window has as many shingles
as its item, so at the bound it shares 2 * percent / (100 + percent) of them with
it: a document's windows are all those of an item's size, at every place, over
which so many shingles are ones of the item, in whatever order. Windows and
items get a 64-bit SimHash; BLOCKS blocks of it are indexed with all values
within RADIUS // BLOCKS bits, so every pair within RADIUS bits of each other
meets in some block. Pairs within the radius are held against each other by
the exact weighted similarity, the sum of the smaller over that of the larger
weights. At the bound of 0.75 two fingerprints differ in 11 bits on average,
with a deviation of 3; RADIUS is four deviations above.

Items of fewer words than a shingle are one shingle of all their words. Null
and empty texts and items match nothing. Rows of the same id and text count
once; rows of a null id are told apart by their text. Items of the same id are
told apart, and the best window counts. Columns other than those named are
not read. The items' index is broadcast if it is counted to be small.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import apart, small, written

SHINGLE = 5
BLOCKS, BITS = 8, 8
RADIUS = 23
#: Bit patterns by which a block may differ: all within RADIUS // BLOCKS bits.
NEAR = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BITS), n)]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]++"), "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))


def fingerprint(hashes: Column) -> Column:
    """SimHash: each bit by the majority of the hashes."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda out, b: out.bitwiseOR(bit(b)))


def _block(print_: Column, block: Column) -> Column:
    return F.call_function("shiftright", print_, block * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def shared_weight(a: Column, b: Column) -> Column:
    """The sum of the smaller weights of two lists of shingles."""

    def least(h: Column) -> Column:
        return F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h)))

    return F.when(a == b, F.size(a)).otherwise(F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + least(h)))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = 75) -> DataFrame:
    """(id, row, item_id, start, similarity): each document's best window of each item it holds; row is a hash of id and text."""
    known = items.select(F.col(item_col).alias("item_id"), words_of(F.coalesce(F.col(item_text), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(SHINGLE))
    by_size = reduce(lambda out, k: out.when(size == k, shingles(F.col("w"), k)), range(2, SHINGLE + 1), F.when(size == 1, shingles(F.col("w"), 1)))
    known = known.select("item_id", size.alias("k"), by_size.alias("own")).withColumn("print", fingerprint(F.col("own"))).distinct()
    # numbers are fixed once they are written
    known = written(known.select("*", F.size("own").alias("n"), F.monotonically_increasing_id().alias("item")), "items")
    sizes = [r.k for r in known.select("k").distinct().collect()]  # at most SHINGLE of them
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, row long, item_id {items.schema[item_col].dataType.simpleString()}, start int, similarity double")

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), words_of(F.col(text_col)).alias("w"))
    seeds = small(known.select("k", "n", "item", F.explode(F.array_distinct("own")).alias("h")))
    # a window as long as its item shares so many shingles with it at the bound
    need = F.ceil(F.col("n") * (2 * percent) / (100 + percent)).cast("int")

    def hits(k: int) -> DataFrame:
        """Per document and item of this shingle size the places of shingles that the item has."""
        # an outer explode, as Spark would else compute the shingles once more to filter out empty lists
        each = texts.select("id", "row", shingles(F.col("w"), k).alias("all")).select("id", "row", "all", F.posexplode_outer("all").alias("p", "h"))
        return each.join(seeds.filter(F.col("k") == k), "h").groupBy("id", "row", "k", "n", "item").agg(F.first("all").alias("all"), F.sort_array(F.collect_set("p")).alias("at"))

    held = written(reduce(DataFrame.union, map(hits, sizes)).filter((F.size("at") >= need) & (F.size("all") >= 1)), "hits")
    # the windows over `need` hits in a row, for each run of so many: all windows that hold as many as the bound asks for
    last = F.size("all") - F.col("n")
    runs = F.transform(F.sequence(F.lit(1), F.size("at") - need + 1), lambda i: F.struct(F.element_at("at", i).alias("low"), F.element_at("at", (i + need - 1).cast("int")).alias("high")))
    starts = F.flatten(F.transform(F.filter(runs, lambda r: r["high"] - r["low"] < F.col("n")), lambda r: F.sequence(F.greatest(F.lit(0), r["high"] - F.col("n") + 1), r["low"])))
    every = F.array_distinct(F.transform(starts, lambda s: F.greatest(F.lit(0), F.least(s, last))))
    found = held.select("id", "row", "k", "n", "all", F.explode(every).alias("start")).select("id", "row", "k", "n", "start", F.slice("all", F.col("start") + 1, F.col("n")).alias("window"))
    found = found.groupBy("id", "row", "k", "n", "start").agg(F.first("window").alias("window"))
    found = written(found.withColumn("print", fingerprint(F.col("window"))), "windows")

    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    near = F.array(*map(F.lit, NEAR))
    index = known.select("item", "k", "n", F.col("print").alias("item_print"), F.explode(blocks).alias("block"))
    index = index.select("*", F.explode(F.transform(near, lambda d: _block(F.col("item_print"), F.col("block")).bitwiseXOR(d))).alias("value"))
    ours = found.select("id", "row", "k", "n", "start", "print", F.explode(blocks).alias("block")).withColumn("value", _block(F.col("print"), F.col("block")))
    close = ours.join(small(index), ["k", "n", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    once = close.select("id", "row", "k", "n", "start", "item").distinct().join(small(known.select("item", "item_id", "own")), "item")
    here = [F.col(f"there.{c}").eqNullSafe(once[c]) for c in ("id", "row", "k", "n", "start")]
    weighed = once.join(found.alias("there"), reduce(Column.__and__, here)).select(once["id"], once["row"], "item_id", once["start"], "window", "own").withColumn("shared", shared_weight(F.col("window"), F.col("own")))
    total = F.size("window") + F.size("own") - F.col("shared")
    similar = weighed.filter(100 * F.col("shared") >= percent * total).select("id", "row", "item_id", "start", (F.col("shared") / total).alias("similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start"))
    return similar.groupBy("id", "row", "item_id").agg(best.alias("best")).select("id", "row", "item_id", F.col("best.start").alias("start"), (-F.col("best.s")).alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = 75) -> DataFrame:
    """docs without the rows that hold an item."""
    row = apart(docs, "row")
    found = written(contaminated(docs, items, id_col, text_col, item_col, item_text, percent).select(F.col("row").alias(row)).distinct(), "contaminated")
    return docs.join(small(found), F.xxhash64(id_col, text_col) == F.col(row), "left_anti")

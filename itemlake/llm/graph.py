"""Links between sets that may be similar, and connected components, by DataFrame operations alone.

Lists (id, value) say which members hold a value; every pair over the bound
meets in some list. `linked` confirms their links in two phases, each of
a fixed number of jobs whatever the data:

1. Short lists give all their pairs, longer ones a star around one member.
   What is confirmed forms components.
2. A long list all of whose members are in one component has nothing to add.
   The members of the others are held against each other by prefixes of their
   whole sets, rarest elements first: two sets over the bound share an element
   of both prefixes, whatever else they share with others, so what many hold
   (a template, a passage) makes no list. This phase is exact. Where its lists
   are crowded, each member is first held against a few others of each list and
   components are found again. Pairs of one component are not formed; lists that
   are still long are dealt in blocks, those outside their commonest component
   against all, and a pair is formed in the first long list that it shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import dealt, drop, scratch, small, sought, written

HOT = 16  # longest list of which every pair is formed
CENTRES = 8  # centres that the long lists of a group have
BLOCK = 1024  # members of a block of a list that is long in the second phase
CROWDED = 16  # pairs to a member of long lists from which a few of each are compared first
BESIDE = (1, 2)  # places in a block's order that lie between these
PARTS = 8  # tables that the elements of sets are dealt into at most, of which one after the other is shuffled
PART = 1 << 23  # elements of such a table from which there are several


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of the edges (a, b) reaches.

    Alternating stars: each node's neighbours are linked to the smallest of
    them, first the larger neighbours, then the smaller ones, until no edge
    changes; then every node is linked to its component's smallest. Edges are
    written each time round, and a node of any degree is a partial minimum.
    Nulls and loops are dropped; no edges give no rows.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if sign == before:
            break
        before = sign
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(least, "u")
        after = joined.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(joined.select("u", F.col("low").alias("v"))).distinct()
        after = written(after, "edges")
        drop(now)
        now = after
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _pairs(lists: DataFrame, fits: Column, *more: str) -> DataFrame:
    """(a, b) of every two members of each bounded list that fit."""
    held = lists.groupBy("value").agg(F.sort_array(F.collect_set(F.struct("id", *more))).alias("m"))
    every = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return held.select(F.explode(every).alias("p")).select("p.x", "p.y").filter(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _mask(value: Column, masks: int = CENTRES) -> Column:
    """One of so many masks, by the value; ids that are combined with it are in another order under each."""
    return F.xxhash64(F.pmod(value, F.lit(masks)))


def candidates(postings: DataFrame, hot: int = HOT, masks: int = CENTRES) -> tuple[DataFrame, DataFrame]:
    """(pairs, long): the pairs (a, b) of short lists and of each long list's star; the members (value, id) of long lists.

    postings (id, value), ids being longs. No list is brought together that
    has more than `hot` members: a first aggregation keeps counts and ends,
    which are all that lists of two need, and the others' members are looked
    up by value. The centres of stars differ with the value, so a member of
    many long lists of a group meets up to `masks` of them.
    """
    masked = F.col("id").bitwiseXOR(_mask(F.col("value"), masks))
    lists = written(postings.groupBy("value").agg(F.count("*").alias("n"), F.min(masked).alias("x"), F.max(masked).alias("y")).filter("n > 1"), "lists", heavy=True)
    x, y = (F.col(c).bitwiseXOR(_mask(F.col("value"), masks)) for c in "xy")
    two = lists.filter("n = 2").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    more = lists.filter("n > 2").select("value", x.alias("x"), (F.col("n") > hot).alias("long"))
    members = written(sought(postings, more, ["value"]), "members")
    star = members.filter("long and id <> x")
    pairs = two.union(_pairs(members.filter("not long"), F.lit(True))).union(star.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))).distinct()
    pairs = written(pairs, "pairs")
    drop(lists)
    return pairs, members.filter("long").select("value", "id")


def centres(members: DataFrame, masks: int = CENTRES) -> DataFrame:
    """(value, x): the centre of each long list's star, of its members (value, id)."""
    least = F.min(F.col("id").bitwiseXOR(_mask(F.col("value"), masks)))
    return members.groupBy("value").agg(least.alias("x")).select("value", F.col("x").bitwiseXOR(_mask(F.col("value"), masks)).alias("x"))


def unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """(id, label, n): members of long lists (value, id) that hold several components, and in how many of these each is."""
    labels = found.select(F.col("node").alias("id"), "label")
    labelled = written(members.join(labels, "id", "left").select("value", "id", F.coalesce("label", "id").alias("label")), "labelled")
    open_ = labelled.groupBy("value").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one <> other").select("value")
    return labelled.join(small(written(open_, "open")), "value", "left_semi").groupBy("id").agg(F.max("label").alias("label"), F.count("*").alias("n"))


def prefixes(elements: DataFrame, percent: int) -> DataFrame:
    """(id, size, label, value, left, least): what every set has in lists of its rarest elements.

    elements (id, label, value): every element of every set once. Elements are
    in the order of how many sets have them. Two sets over the bound share at
    least percent / (100 + percent) of the sum of their sizes, and of what they
    share, the first element has so many elements left in either. What is
    shuffled at once is a part of the elements, by their value and then by set.
    """
    parts = dealt(elements.select("id", "label", "value"), "value", PARTS, "elements")
    if not parts:
        parts = [written(elements.select("id", "label", "value"), "elements")]
    rounds = max(1, min(len(parts), -(-_all(parts).count() // PART)))
    sizes = written(_all(parts).groupBy("id").agg(F.count("*").alias("size"), F.max("label").alias("label")), "sizes")

    def counted() -> Iterator[DataFrame]:
        for i in range(rounds):
            some = _all(parts[i::rounds])
            yield some.join(some.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1"), "value").select("id", "n", "value")
            drop(*parts[i::rounds])

    shared = written(counted(), "shared")

    def posted() -> Iterator[DataFrame]:
        for i in range(rounds):
            some = shared.filter(F.pmod(F.xxhash64("id", F.lit(37)), F.lit(rounds)) == i)
            ranked = some.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("v")).join(sizes, "id")
            # elements that no other set has come first and make no list; a larger set shares percent of its own with a smaller one at least
            alone = F.col("size") - F.size("v")
            first = F.slice("v", F.lit(1), F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - alone).cast("int"))
            each = ranked.select("id", "size", "label", alone.alias("alone"), F.posexplode(first).alias("at", "e"))
            left = F.col("size") - F.col("alone") - F.col("at")
            least = left >= F.ceil(2 * F.lit(percent / (100 + percent)) * F.col("size"))
            yield each.select("id", "size", "label", F.col("e.value").alias("value"), left.alias("left"), least.alias("least"))

    out = written(posted(), "prefixes")
    drop(shared, sizes)
    return out


def _all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _fits(percent: int) -> Callable[[Column, Column], Column]:
    """Whether two members of a list of prefixes may be over the bound and are in different components."""

    def fits(x: Column, y: Column) -> Column:
        least = F.ceil(F.lit(percent / (100 + percent)) * (x["size"] + y["size"]))
        return (x["label"] != y["label"]) & (x["left"] >= least) & (y["left"] >= least)

    return fits


def _open(posted: DataFrame) -> DataFrame:
    """(value, n, k): the lists that hold several components, their members and those that are the smaller of a pair there."""
    sums = posted.groupBy("value").agg(F.count("*").alias("n"), F.count_if("least").alias("k"), F.min("label").alias("one"), F.max("label").alias("other"))
    return written(sums.filter("k > 0 and n > 1 and one <> other").select("value", "n", "k"), "lists")


def nearby(posted: DataFrame, percent: int) -> DataFrame | None:
    """(a, b): a few of the pairs of each long list of prefixes, some for every member; None if such lists have few pairs anyway.

    What these confirm joins most of a group of near copies, whose pairs then need not be formed.
    """
    fits, lists = _fits(percent), _open(posted)
    crowd = lists.filter(F.col("n") > HOT)
    sums = crowd.agg(F.sum(F.col("n") * F.col("k")).alias("pairs"), F.sum("n").alias("members")).first()
    if (sums.pairs or 0) <= CROWDED * (sums.members or 0):
        return None
    long = posted.join(small(crowd), "value")
    block = F.pmod(F.xxhash64("id", "value"), F.ceil(F.col("n") / BLOCK))
    held = long.groupBy("value", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("value", "id").alias("order"), "id", "size", "label", "left"))).alias("m"))
    near = F.flatten(F.array(*(F.transform(F.slice("m", d + 1, F.size("m")), lambda y, i: F.struct(F.get("m", i).alias("x"), y.alias("y"))) for d in BESIDE)))
    each = held.select(F.explode(F.filter(near, lambda p: fits(p["x"], p["y"]))).alias("p"))
    out = written(each.select(F.least("p.x.id", "p.y.id").alias("a"), F.greatest("p.x.id", "p.y.id").alias("b")).distinct(), "beside")
    drop(lists)
    return out


def relabelled(posted: DataFrame, found: DataFrame) -> DataFrame:
    """posted with the labels of found (node, label)."""
    labels = found.select(F.col("node").alias("id"), "label")
    return written(posted.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "prefixes")


def _crowd(posted: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, size, label, value, left, before, side): members of long lists of prefixes, once each.

    side: of every two members of a list whose labels differ and that may be over
    the bound, one is on it: all but those of the list's commonest label, or the
    possibly smaller of a pair, whichever are fewer. before: the member's long
    lists of rarer elements.
    """
    long = posted.join(small(lists), "value")
    most = long.groupBy("value", "label").agg(F.count("*").alias("c")).groupBy("value").agg(F.max_by("label", F.struct("c", "label")).alias("common"), F.max("c").alias("c"))
    side = F.when(F.col("n") - F.col("c") <= F.col("k"), F.col("label") != F.col("common")).otherwise(F.col("least"))
    long = long.join(small(written(most, "commonest")), "value").withColumn("side", side)
    ranked = long.groupBy("id").agg(F.max("size").alias("size"), F.max("label").alias("label"), F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("rank"), "value", "side"))).alias("m"))
    each = ranked.select("id", "size", "label", "m", F.posexplode("m").alias("at", "e"))
    before = F.transform(F.slice("m", F.lit(1), F.col("at")), lambda e: e["value"])
    return each.select("id", "size", "label", "e.value", (-F.col("e.rank")).alias("left"), before.alias("before"), "e.side")


def crowd_pairs(posted: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of sets in different components of long lists of prefixes, each in the first list that it shares."""
    fits, member = _fits(percent), ("size", "label", "left", "before")
    # members of one side are dealt in blocks, which all others meet
    long = written(_crowd(posted, lists), "crowd")
    blocks = long.groupBy("value").agg(F.ceil(F.count_if("side") / BLOCK).alias("blocks"))
    long = long.join(small(written(blocks, "blocks")), "value")
    dealt = long.filter("side").groupBy("value", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("id", *member)).alias("m"))
    beside = long.filter("blocks > 0").select("value", "side", F.struct("id", *member).alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    once = lambda x: fits(x, F.col("y")) & (~F.col("side") | (x["id"] < F.col("y.id"))) & ~F.arrays_overlap(x["before"], F.col("y.before"))
    return beside.join(dealt, ["value", "block"]).select(F.col("y.id").alias("b"), F.explode(F.transform(F.filter("m", once), lambda x: x["id"])).alias("a")).select("a", "b")


def prefix_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b): a superset of the pairs over the bound of sets in different components, by their prefixes."""
    lists = _open(posted)
    some = posted.join(small(lists.filter(F.col("n") <= HOT).select("value")), "value")
    few = _pairs(some, _fits(percent)(F.col("x"), F.col("y")), "size", "label", "left")
    met = crowd_pairs(posted, lists.filter(F.col("n") > HOT), percent)
    return few.union(met.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def linked(postings: Sequence[DataFrame], percent: int, verify: Callable[[DataFrame], DataFrame], elements: Callable[[DataFrame], DataFrame], hot: int = HOT) -> DataFrame:
    """(node, label): components of the links that verify() confirms.

    postings: tables (id, value) that have no list in common, with an id in a list once; they are
    shuffled one after the other. verify turns pairs (a, b)
    into those over the bound; elements turns members (id, label, n) of n open
    lists into the whole sets (id, label, value) of those that may have
    a link there.
    """
    with scratch() as keep:
        met = [candidates(some, hot) for some in postings]
        pairs, long = (_all(tables) for tables in zip(*met))
        pairs = pairs if len(met) == 1 else written(pairs.distinct(), "pairs")
        links = keep(_kept(lambda: verify(pairs), "links"))
        found = keep(_kept(lambda: components(links), "components"))
        open_ = None if long.isEmpty() else keep(_kept(lambda: unsettled(long, found), "open"))
    if open_ is None or open_.isEmpty():
        return found
    with scratch() as keep:
        posted = keep(prefixes(elements(open_), percent))
    few = nearby(posted, percent)
    if few is not None:
        links = _kept(lambda known=links: known.union(verify(few)), "links")
        found = _kept(lambda: components(links), "components")
        before, posted = posted, relabelled(posted, found)
        drop(before)
    pairs = _kept(lambda: prefix_pairs(posted, percent), "pairs")
    drop(posted)
    more = _kept(lambda: verify(pairs), "links")
    return found if more.isEmpty() else components(links.union(more))


def _kept(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives as a table, without those made on the way."""
    with scratch() as keep:
        return keep(written(make(), name))

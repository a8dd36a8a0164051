"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct shingles of SHINGLE words (ASCII letters
lower-cased, ASCII white space between words), each a 63-bit hash; fewer words
are one shingle. Documents of one set are a class, which is compared once. Its
sketch is the K smallest hashes. All of them post the class to
inverted lists, whose overlaps are the candidates; the K smallest hashes of
the union of two sketches estimate their similarity, and pairs far below the
bound go; the others are held against each other's full sets.

Two sets of similarity s meet in no list with probability (1 - s) ** K, 3e-39
at the bound of 0.75, and the estimate misses it by MARGIN standard errors.
Values that many classes retain (a template, a common passage) make long lists:
their members are settled as graph.linked says, in components first and then by
prefixes of the whole sets, so neither shared passages nor large groups form all
pairs and no link is left out.

Null and empty texts, and texts of white space, have the empty set and are
linked with nothing. Rows that repeat are of one class. Rows of a null id take
part, but cannot be kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import drop, scratch, small, small_batches, written
from itemlake.llm.graph import linked

SHINGLE = 5
K = 64
MARGIN = 4.5
PIECE = 1 << 20  # bytes that are hashed at once

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and where it starts."""
    code = np.frombuffer(raw, dtype=np.uint8)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    shift = starts[0]
    code, blank, starts = code[shift:], blank[shift:], starts - shift
    place = np.arange(len(code)) - np.repeat(starts, np.diff(starts, append=len(code)))
    powers = np.cumprod(np.full(int(place.max()) + 1, _MULT, dtype=np.uint64))
    value = (code.astype(np.uint64) + np.uint64(1)) * powers[place]
    value[blank] = 0
    return _mix(np.add.reduceat(value, starts)), starts + shift


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's set as sorted distinct hashes."""
    weights = np.cumprod(np.full(size, np.uint64(0xD1342543DE82EF95), dtype=np.uint64))
    at = 0
    while at < len(texts):
        raws, total = [], 0
        while at < len(texts) and (not raws or total < PIECE):
            raws.append((texts[at] or "").encode("utf-8", "surrogatepass").lower())
            total += len(raws[-1]) + 1
            at += 1
        words, starts = word_hashes(b" ".join(raws))
        first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        if len(words) >= size:
            sums = sum(words[i : len(words) - size + 1 + i] * weights[i] for i in range(size))
            all_hashes = (_mix(sums) >> np.uint64(1)).astype(np.int64)
        for a, b in zip(first, first[1:]):
            if b - a >= size:
                yield np.unique(all_hashes[a : b - size + 1])
            elif b > a:
                sums = (words[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield (_mix(np.array([sums])) >> np.uint64(1)).astype(np.int64)
            else:
                yield np.empty(0, dtype=np.int64)


def _lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat, pa.int64()))


def shingled(docs: DataFrame, most: int | None, size: int = SHINGLE) -> DataFrame:
    """(id, n, key, hashes): the set's size, a 128-bit digest (null if empty), its `most` smallest hashes (None: all)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1).to_pylist(), size))
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(keys, pa.binary()), _lists_of([x[:most] for x in found])], ["id", "n", "key", "hashes"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(sets, f"id {docs.schema['id'].dataType.simpleString()}, n long, key binary, hashes array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component): per row its set's size and the smallest id that links reach."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = written(shingled(rows, K, size), "sketches")
    classes = sketched.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    # numbers are fixed once they are written
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    keyed = written(sketched.select("id", "n", "key"), "keyed")
    drop(sketched)
    posted = classes.select(F.col("cls").alias("id"), F.explode("hashes").alias("value"))
    bound = percent / 100
    margin = MARGIN * (bound * (1 - bound) / K) ** 0.5

    def whole(needed: DataFrame) -> DataFrame:
        """(cls, hashes): the whole sets of these classes, from the texts of their smallest ids."""
        sources = written(classes.join(small(needed), "cls", "left_semi").select("key", "cls", F.col("id").alias("source")), "sources")
        texts = rows.join(small(sources.select("source").distinct()), F.col("id").eqNullSafe(F.col("source")), "left_semi")
        return written(shingled(texts, None, size).select("key", "hashes").join(small(sources.select("key", "cls")), "key").select("cls", "hashes").dropDuplicates(["cls"]), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("hashes").alias(f"h_{s}")) for s in "ab")
        sizes = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
        union = F.slice(F.array_sort(F.array_union("h_a", "h_b")), 1, K)
        share = F.size(F.array_intersect(F.array_intersect("h_a", "h_b"), union)) / F.size(union)
        likely = written(pairs.join(a, "a").join(b, "b").filter(sizes).filter(share >= bound - margin).select("a", "b", "n_a", "n_b"), "likely")
        full = whole(written(likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct(), "needed"))
        sets_a, sets_b = (full.select(F.col("cls").alias(s), F.col("hashes").alias(f"s_{s}")) for s in "ab")
        found = likely.join(sets_a, "a").join(sets_b, "b").withColumn("shared", F.size(F.array_intersect("s_a", "s_b")))
        return found.filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")

    def elements(open_: DataFrame) -> DataFrame:
        # a pair over the bound shares so many retained values; one that shares none in a short list has all of them in open ones
        least = F.least(F.ceil(F.col("size") * percent / 100), F.lit(int(K * (bound - margin))))
        hot = open_.join(classes.select(F.col("cls").alias("id"), F.col("n").alias("size")), "id").filter(F.col("n") >= least)
        hot = written(hot.select("id", "label"), "hot")
        held = whole(hot.select(F.col("id").alias("cls"))).withColumnRenamed("cls", "id").join(hot, "id")
        return held.select("id", "label", F.explode("hashes").alias("value"))

    with scratch() as keep:
        labels = keep(written(linked([posted], percent, verify, elements), "labels"))
    named = labels.join(classes.select(F.col("cls").alias("node"), "id"), "node")
    lowest = named.groupBy("label").agg(F.min("id").alias("component"))
    linked_to = named.join(lowest, "label").select(F.col("node").alias("cls"), "component")
    of_class = classes.select("cls", "key", "id").join(linked_to, "cls", "left").select("key", F.coalesce("component", "id").alias("component"))
    of_class = written(of_class, "of_class")
    drop(classes, labels)
    joined = keyed.join(of_class, "key", "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))

"""Token counts by a two-tier lookup on the map side.

A first pass over all documents counts chunks (runs without ASCII white
space, which no pre-token of a tokenizer that drops white space crosses): each
task keeps a bounded table of counts and hands on its most frequent chunks, and
the sums of those name the `frequent` most frequent chunks of the corpus. Their
token counts, found once on the driver, are the broadcast table: at most
`frequent` entries of at most `longest` bytes. A second pass adds up table
entries; other chunks are encoded by the library in batches and kept in a
bounded cache of the worker. Chunks are never shuffled, only the bounded
summaries are. The table decides the speed alone, never a count.

Null and empty texts: 0 bytes, 0 tokens. Rows map one to one; an existing
output column is replaced. Texts holding a special string go through the
library chunk by chunk as any other, so its default handling applies.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from itemlake.llm.common import small_batches

FREQUENT = 1 << 16  # entries of the broadcast table
LONGEST = 64  # bytes of an entry
SUMMARY = 1 << 13  # chunks that each task hands on
PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
HELD = 1 << 18  # chunks that a task counts at once
CACHE = 1 << 18  # chunks in each half of a worker's cache


def chunks_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def parts_of(chunk: bytes) -> list[bytes]:
    """The chunk, cut where a pre-token is sure to end and in lower case if ASCII, so that more chunks share parts.

    ASCII punctuation that ends a chunk is a pre-token of its own behind an
    ASCII letter or digit; apostrophes may begin a contraction and special
    strings hold punctuation, so neither is cut.
    """
    base = chunk.rstrip(PUNCTUATION)
    if base and len(base) < len(chunk) and base[-1:].isalnum() and b"<|" not in chunk:
        return [base.lower() if base.isascii() else base, chunk[len(base) :]]
    return [chunk.lower() if chunk.isascii() and b"<|" not in chunk else chunk]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def lengths(path: str, chunks: list[bytes]) -> list[int]:
    found = tokenizer(path).encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
    return [len(x) for x in found]


def summaries(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, n): frequent chunks of each task with their counts there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(chunks_of(t.as_py()))
                if len(seen) > HELD:  # the rarest go; what is frequent in the task stays
                    seen = Counter(dict(seen.most_common(HELD // 2)))
        top = [(c, n) for c, n in seen.most_common(SUMMARY) if len(c) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["chunk", "n"])

    return docs.select(F.col(text)).mapInArrow(count, "chunk binary, n long")


def frequent_chunks(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> list[bytes]:
    rows = summaries(docs, text).groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(frequent)
    return [bytes(r.chunk) for r in rows.select("chunk").toLocalIterator()]


class Tiers:
    """The broadcast table, and a worker's cache in two halves."""

    def __init__(self, path: str, table: dict[bytes, int]):
        self.path, self.table = path, table
        self.known, self.old = dict(table), {}

    def count(self, chunks: list[bytes]) -> int:
        if len(self.known) > len(self.table) + CACHE:
            self.known, self.old = dict(self.table), self.known
        missing, known, old = {}, self.known, self.old
        for chunk in set(chunks).difference(known):
            n = old.get(chunk)
            if n is None:
                missing[chunk] = parts_of(chunk)
            else:
                known[chunk] = n
        if missing:
            new = list({p for parts in missing.values() for p in parts if p not in known})
            known.update(zip(new, lengths(self.path, new)))
            for chunk, parts in missing.items():
                known[chunk] = sum(map(known.__getitem__, parts))
        return sum(map(self.known.__getitem__, chunks))


_tiers: dict[tuple[str, str], Tiers] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens; path must be readable on every worker."""
    spark = docs.sparkSession
    small_batches(spark)
    top = frequent_chunks(docs, text, frequent)
    table = spark.sparkContext.broadcast(dict(zip(top, lengths(path, top))))
    key = (path, uuid.uuid4().hex)  # a worker serves many jobs

    @F.arrow_udf(IntegerType())
    def tokens(texts: pa.Array) -> pa.Array:
        if key not in _tiers:
            _tiers.clear()
            _tiers[key] = Tiers(path, table.value)
        tiers, out = _tiers[key], []
        for t in texts:
            out.append(tiers.count(chunks_of(t.as_py())))
        return pa.array(out, pa.int32())

    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(F.col(text)).cast("long")})

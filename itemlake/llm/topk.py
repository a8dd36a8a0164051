"""Exact inner-product top-k by a three-phase uniform threshold.

A vector's components are dealt into `slices`, and a score is the sum of its
slices' partial scores. Vectors and queries are dealt into groups of a bounded
size, and every pair of a query group and a vector group is worked on by numpy
in one task, a block at a time. A vector is so sent once for each query group
and a query once for each vector group, and none of them by the driver.

1. From each block and slice the k + 1 best partial scores of each query are
   gathered as its local lists and resolved, a group's best are kept; the (k + 1)th best score found
   anywhere is the query's cutoff tau. It is safe: that many vectors reach it.
2. The cutoff is sent to all blocks with the queries. A score of at least tau
   needs a partial score of at least tau / slices, so each slice's entries
   over that uniform threshold are sufficient.
3. Their other partial scores are resolved exactly; those under tau go.

Equal vectors form one class, which is scored once and stands for its k + 1
smallest ids: ties go to the smaller id, so no other member can be in a top k.

Vectors that are null, or hold a null or non-finite component, take no part.
A shorter vector counts as padded with zeros. Rows that repeat an id and its
vector count once; an id with two vectors is two candidates, neither of which
meets the id's own queries. Scores are 64-bit integers; blocks whose scores
might pass 2^53 are multiplied as integers. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from itemlake.llm.common import written

SCALE = 64
ROWS, QUERIES = 2048, 512  # of a block
GROUP = 1 << 14  # vectors or queries of a group
TASKS = 24  # pairs of groups at least, if they have more vectors than a block

NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, q): ids and floor(SCALE * x) of every vector that takes part."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("q"))


def classes_of(points: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(q, cls, asks, ids): distinct vectors, whether a query has it, its k + 1 smallest ids."""
    smallest = points.distinct().withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("id"))).filter(F.col("at") <= k + 1)
    members = smallest.groupBy("q").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = points.filter(is_query).select("q").distinct().withColumn("asks", F.lit(True))
    # two ids may share the smallest id of different vectors, so classes are numbered by vector
    return members.join(asked, "q", "left").select("q", F.struct("cls", F.xxhash64("q")).alias("cls"), F.coalesce("asks", F.lit(False)).alias("asks"), "ids")


def grid(rows: int, queries: int) -> tuple[int, int]:
    """How many groups of vectors and of queries there are."""
    of_queries = max(1, -(-queries // GROUP))
    return max(1, -(-rows // GROUP), min(-(-rows // ROWS), -(-TASKS // of_queries))), of_queries


def spread(rows: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
    """rows in a group `own` of n, dealt by hash, once for each of the other side's groups."""
    dealt = rows.withColumn(own, F.pmod(F.xxhash64("cls", F.lit(17)), F.lit(n)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(2 * n * others, "rg", "qg")


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=np.int64)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out[np.repeat(np.arange(len(lists)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _matrices(queries: pa.Table, rows: pa.Table) -> list[np.ndarray]:
    """The queries and the vectors of a pair of groups."""
    lists = [x.column("q").combine_chunks() for x in (queries, rows)]
    width = max(1, *(pc.max(x.value_lengths()).as_py() or 0 for x in lists))
    both = [_matrix(x, width) for x in lists]
    peak = float(np.abs(both[0]).max(initial=0)) * float(np.abs(both[1]).max(initial=0)) * width
    return [x.astype(np.float64) for x in both] if peak < 2**53 else both  # then float products and sums are exact, and fast


def _partial(a: np.ndarray, b: np.ndarray, slices: int) -> list[np.ndarray]:
    """Each slice's partial scores of a query block and a vector block."""
    return [a[:, s::slices] @ b[:, s::slices].T for s in range(slices)]


def _lists(k: int, slices: int, schema: pa.Schema):
    def gather(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        a, b = _matrices(queries, rows)
        best = np.full((len(a), k + 1), NONE)
        for i in range(0, len(a), QUERIES):
            for j in range(0, len(b), ROWS):
                parts = _partial(a[i : i + QUERIES], b[j : j + ROWS], slices)
                total = sum(parts)
                n = total.shape[1]
                local = np.zeros(total.shape, dtype=bool)
                for part in parts:
                    most = np.argpartition(-part, k, axis=1)[:, : k + 1] if n > k + 1 else np.tile(np.arange(n), (len(part), 1))
                    np.put_along_axis(local, most, True, axis=1)
                resolved = np.where(local, total.astype(np.int64), NONE)
                if n > k + 1:
                    resolved = np.partition(resolved, -(k + 1), axis=1)[:, -(k + 1) :]
                both = np.concatenate([best[i : i + QUERIES], resolved], axis=1)
                best[i : i + QUERIES] = np.partition(both, -(k + 1), axis=1)[:, -(k + 1) :]
        scores = pa.array([x[x != NONE] for x in best], pa.list_(pa.int64()))
        return pa.Table.from_arrays([queries.column("cls").combine_chunks(), scores], schema=schema)

    return gather


def _over(slices: int, schema: pa.Schema):
    def resolve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        a, b = _matrices(queries, rows)
        tau = queries.column("tau").to_numpy()[:, None]
        found = [[np.empty(0, dtype=np.int64)] for _ in range(3)]
        for i in range(0, len(a), QUERIES):
            for j in range(0, len(b), ROWS):
                parts, own = _partial(a[i : i + QUERIES], b[j : j + ROWS], slices), tau[i : i + QUERIES]
                enough = np.zeros(parts[0].shape, dtype=bool)
                for part in parts:
                    enough |= part * slices >= own
                q, r = np.nonzero(enough)
                score = sum(part[q, r].astype(np.int64) for part in parts)
                keep = score >= own[q, 0]
                for to, x in zip(found, (q[keep] + i, r[keep] + j, score[keep])):
                    to.append(x)
        q, r, score = (pa.array(np.concatenate(x), pa.int64()) for x in found)
        return pa.Table.from_arrays([queries.column("cls").combine_chunks().take(q), rows.column("cls").combine_chunks().take(r), score], schema=schema)

    return resolve


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", slices: int = 2) -> DataFrame:
    """(query_id, rank, id, score): each query's k best other vectors; is_query is a Column over `id`."""
    points = quantised(vectors, id_col, vector_col)
    classes = written(classes_of(points, is_query, k), "classes", heavy=True)
    sizes = classes.agg(F.count("*").alias("rows"), F.count_if("asks").alias("queries")).first()
    nr, nq = grid(sizes.rows, sizes.queries)
    key = classes.schema["cls"].dataType
    rows = spread(classes.select("cls", "q"), "rg", nr, "qg", nq).groupBy("rg", "qg")

    def paired(queries: DataFrame, work: Callable[[pa.Schema], Callable], schema: StructType) -> DataFrame:
        """What work gives for every group of queries beside every group of vectors."""
        return spread(queries, "qg", nq, "rg", nr).groupBy("rg", "qg").cogroup(rows).applyInArrow(work(to_arrow_schema(schema)), schema)

    # tables are small in files and large as rows, so no join is left to guess that one can be broadcast
    askers = classes.filter("asks").select("cls", "q")
    lists = paired(askers, lambda schema: _lists(k, slices, schema), StructType().add("asker", key).add("scores", ArrayType(LongType())))
    each = lists.select("asker", F.explode("scores").alias("score")).withColumn("at", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"))))
    tau = each.filter(F.col("at") <= k + 1).groupBy("asker").agg(F.min("score").alias("tau"))
    cutoffs = written(askers.join(tau.hint("merge"), askers.cls == tau.asker).select("cls", "q", "tau"), "cutoffs", heavy=True)
    scored = paired(cutoffs, lambda schema: _over(slices, schema), StructType().add("asker", key).add("cls", key).add("score", LongType()))

    found = scored.join(classes.select("cls", F.explode("ids").alias("id")).hint("merge"), "cls").select("asker", "id", "score")
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))).filter(F.col("at") <= k + 1)
    asking = points.filter(is_query).distinct().join(classes.select("q", F.col("cls").alias("asker")).hint("merge"), "q").select(F.col("id").alias("query_id"), "asker")
    own = asking.join(best.hint("merge"), "asker").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return own.select("query_id", rank.alias("rank"), "id", "score").filter(F.col("rank") <= k)

"""Document scores by a masked language model: pseudo-likelihood from both sides.

Words (lower case, by white space) become VOCAB tokens: the corpus' TOP most
frequent words, and hash buckets for the others. A network predicts each token
from the window around it, itself masked: the embeddings of REACH tokens on
either side, one table for each place, are added to a hidden layer, whose tanh
feeds a softmax in two steps, the token's class and the token in its class, so
that probabilities are exact at the cost of two short softmaxes. A word in a
bucket has its bucket's probability times its share of the bucket, n of N + 1
occurrences over all documents; a word that the corpus lacks counts as the one
left over. So the vocabulary is every word of the corpus, and grows with it;
what is of fixed size is the network that weighs contexts. A document's score
is the sum of its words' log-probabilities.

Shares of the next HEAD words are looked up where texts are scored. Words
beyond those are joined to their counts in Spark, by text, so that copies of a
text cost one lookup; no count is left out (the log of a count of one is 0).

Training is data-parallel over all documents, half of them in each of two
rounds: every partition runs Adagrad in numpy from the round's start over its
documents, and the weights are averaged, weighted by tokens, with Spark's sums
over (place, value) chunks. The driver holds one model, of a fixed size. As
each partition trains alone, the weights depend on how rows are partitioned.

Null and empty texts, and texts of white space, have no tokens: sum 0, mean
null. Rows map one to one; other columns stay and an output column of the same
name is replaced. An empty corpus gives an untrained model. Texts are told
apart by two 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import apart, small_batches, written

TOP, BUCKETS = 768, 255
VOCAB = TOP + BUCKETS + 1  # and one token beyond the ends of a text
SIDE = 32  # classes, and tokens of a class
REACH, DIM = 2, 16
PLACES = [d for d in range(-REACH, REACH + 1) if d]
SAFE = 40.0  # logits up to which exponentials and their sums are far from a float's ends
BATCH = 4096  # tokens
RATE = 0.1
HELD = 1 << 18  # words that a task counts at once
CHUNK = 1 << 12  # weights of a row
HEAD = 1 << 16  # words whose shares each task holds, at most WORD bytes each
WORD = 64
SALTS = 16  # parts of the rows of a hot text

SHAPES = {"around": (2 * REACH, VOCAB, DIM), "hidden": (DIM,), "classes": (DIM, SIDE), "class_bias": (SIDE,), "inner": (SIDE, DIM, SIDE), "inner_bias": (SIDE, SIDE)}


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; tasks hand on sums, so a frequent word is a few rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(words_of(t.as_py()))
            if len(seen) > HELD:
                yield out()
                seen.clear()
        yield out()

    small_batches(docs.sparkSession)
    return docs.select(F.col(text)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Places of the frequent words; of any other word -1 - its bucket.

    token and share go by place: the word's token, and the log of its share of
    that. totals holds the log of each bucket's N + 1.
    """

    def __init__(self, words: list[bytes], n: np.ndarray, totals: np.ndarray):
        super().__init__((w, i) for i, w in enumerate(words))
        bucket = np.array([zlib.crc32(w) % BUCKETS for w in words[TOP:]], dtype=np.int32)
        self.n, self.totals = n, totals
        self.token = np.concatenate([np.arange(min(TOP, len(words)), dtype=np.int32), TOP + bucket, [0]]).astype(np.int32)  # one more, so that it is never empty
        self.share = np.concatenate([np.zeros(min(TOP, len(words))), np.log(n[TOP:]) - totals[bucket], [0.0]])

    def __reduce__(self):
        return Vocabulary, (list(self), self.n, self.totals)

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word) % BUCKETS


@dataclass(frozen=True)
class Model:
    """What training gives; counts (word, n) has every word of the corpus that occurs more than once and is in neither table."""

    vocabulary: Vocabulary
    weights: dict[str, np.ndarray]
    counts: DataFrame


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def tokens(vocabulary: Vocabulary, words: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the words of texts of these sizes, each with REACH ends before and after; where the words are; the words' places."""
    place = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
    at = np.arange(len(words)) + np.repeat(REACH * (1 + 2 * np.arange(len(sizes))), sizes)
    token = np.full(len(words) + 2 * REACH * len(sizes), VOCAB - 1, dtype=np.int32)
    token[at] = np.where(place >= 0, vocabulary.token[np.maximum(place, 0)], TOP - 1 - place)
    return token, at, place


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    return {k: (random.standard_normal(s) * 0.1).astype(np.float32) if "bias" not in k and k != "hidden" else np.zeros(s, dtype=np.float32) for k, s in SHAPES.items()}


def _softmax(x: np.ndarray, most: float) -> np.ndarray:
    """In place; logits of an absolute value up to `most`, if that is far from overflow, need no shift by their maximum."""
    if not most <= SAFE:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[-1], dtype=x.dtype))[:, None]
    return x


def _forward(model: dict[str, np.ndarray], token: np.ndarray, at: np.ndarray):
    """Hidden layer, order of targets by class, each class's slice, and both softmaxes at places `at`."""
    target = token[at]
    order = np.argsort((target // SIDE).astype(np.int8), kind="stable")
    at, target = at[order], target[order]
    h = np.repeat(model["hidden"][None], len(at), axis=0)
    for i, d in enumerate(PLACES):
        h += model["around"][i].take(token[at + d], axis=0)
    np.tanh(h, out=h)
    ends = np.searchsorted(target // SIDE, np.arange(SIDE + 1))
    outer = h @ model["classes"]
    outer += model["class_bias"]
    # the hidden layer is within -1 and 1
    _softmax(outer, (np.abs(model["classes"]).sum(axis=0) + np.abs(model["class_bias"])).max())
    most = (np.abs(model["inner"]).sum(axis=1) + np.abs(model["inner_bias"])).max()
    inner = np.empty((len(at), SIDE), dtype=np.float32)
    for c in np.flatnonzero(np.diff(ends)):
        own = inner[ends[c] : ends[c + 1]]
        np.matmul(h[ends[c] : ends[c + 1]], model["inner"][c], out=own)
        own += model["inner_bias"][c]
    _softmax(inner, most)
    return order, at, target, h, ends, outer, inner


def log_probabilities(model: dict[str, np.ndarray], token: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), dtype=np.float64)
    for i in range(0, len(at), BATCH):
        order, _, target, _, _, outer, inner = _forward(model, token, at[i : i + BATCH])
        n = np.arange(len(target))
        out[i + order] = np.log(np.maximum(outer[n, target // SIDE], 1e-30)) + np.log(np.maximum(inner[n, target % SIDE], 1e-30))
    return out


def train_step(model: dict[str, np.ndarray], squares: dict[str, np.ndarray], token: np.ndarray, at: np.ndarray) -> None:
    """One Adagrad step on the places `at`."""
    _, at, target, h, ends, outer, inner = _forward(model, token, at)
    n = np.arange(len(at))
    outer[n, target // SIDE] -= 1
    inner[n, target % SIDE] -= 1
    grad = {"classes": h.T @ outer, "class_bias": outer.sum(axis=0), "inner": np.zeros_like(model["inner"]), "inner_bias": np.zeros_like(model["inner_bias"])}
    back = outer @ model["classes"].T
    for c in np.flatnonzero(np.diff(ends)):
        own = slice(ends[c], ends[c + 1])
        grad["inner"][c], grad["inner_bias"][c] = h[own].T @ inner[own], inner[own].sum(axis=0)
        back[own] += inner[own] @ model["inner"][c].T
    back *= 1 - h * h
    grad["hidden"] = back.sum(axis=0)
    around, columns = np.zeros_like(model["around"]), np.ascontiguousarray(back.T, dtype=np.float64)
    for i, d in enumerate(PLACES):
        neighbour = token[at + d].astype(np.intp)
        for j in range(DIM):
            around[i, :, j] = np.bincount(neighbour, columns[j], minlength=VOCAB)
    grad["around"] = around
    for k, g in grad.items():
        g = g / np.float32(len(at))
        squares[k] += g * g
        model[k] -= np.float32(RATE) * g / np.sqrt(squares[k])


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start = shared.value
        model = {k: v.copy() for k, v in start.items()}
        squares, n = {k: np.full(v.shape, 1e-6, dtype=np.float32) for k, v in model.items()}, 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 64):
                some = list(map(words_of, texts[i : i + 64]))
                token, at, _ = tokens(vocabulary, list(chain.from_iterable(some)), list(map(len, some)))
                for j in range(0, len(at), BATCH):
                    train_step(model, squares, token, at[j : j + BATCH])
                n += len(at)
        if n:
            flat = np.concatenate([model[k].ravel() for k in SHAPES]).astype(np.float64) * n
            chunks = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([n] * len(chunks), pa.int64()), pa.array(chunks, pa.list_(pa.float64()))], ["chunk", "n", "weights"])

    return run


def vocabulary_of(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of counts (word, n), and the counts that it does not hold and that differ from one."""
    held = counts.filter(F.length("word") <= WORD).orderBy(F.desc("n"), "word").limit(TOP + HEAD).toArrow()  # TOP + HEAD short words
    words, n = held["word"].to_pylist(), held["n"].to_pylist()
    totals = np.ones(BUCKETS)
    for row in counts.groupBy((F.crc32("word") % BUCKETS).alias("bucket")).agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        totals[row.bucket] += row.n
    for word, times in zip(words[:TOP], n):
        totals[zlib.crc32(word) % BUCKETS] -= times
    beyond = counts.filter("n > 1")
    if words:  # the held words come before all other short ones by n, then by word
        later = (F.col("n") < n[-1]) | ((F.col("n") == n[-1]) & (F.col("word") > F.lit(bytearray(words[-1]))))
        beyond = beyond.filter((F.length("word") > WORD) | later)
    return Vocabulary(words, np.array(n, dtype=np.float64), np.log(totals)), beyond


def train(docs: DataFrame, text: str = "text", rounds: int = 2) -> Model:
    vocabulary, counts = vocabulary_of(written(word_counts(docs, text), "words"))
    model = initial()
    for k in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
        share = docs.select(F.col(text)).filter(F.pmod(F.xxhash64(text), F.lit(rounds)) == k)
        trained = share.mapInArrow(_trainer(shared), "chunk int, n long, weights array<double>")
        summed = trained.select("chunk", "n", F.posexplode("weights").alias("i", "w")).groupBy("chunk", "i").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        rows = summed.select("chunk", "i", (F.col("w") / F.col("n")).alias("w")).toArrow()  # one model
        if rows.num_rows:
            flat = rows["w"].to_numpy()[np.lexsort((rows["i"].to_numpy(), rows["chunk"].to_numpy()))].astype(np.float32)
            cuts = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])
            model = {name: flat[a:b].reshape(shape) for (name, shape), a, b in zip(SHAPES.items(), cuts, cuts[1:])}
        shared.unpersist()
    return Model(vocabulary, model, counts)


def _scorer(shared):
    @F.arrow_udf("struct<n:bigint,total:double,rare:array<binary>>")
    def scores(texts: pa.Array) -> pa.Array:
        vocabulary, net = shared.value
        texts, n, total, rare = texts.to_pylist(), [], [], []
        for i in range(0, len(texts), 64):
            some = list(map(words_of, texts[i : i + 64]))
            words, sizes = list(chain.from_iterable(some)), np.array(list(map(len, some)))
            token, at, place = tokens(vocabulary, words, sizes)
            other = np.flatnonzero(place < 0)
            found = log_probabilities(net, token, at) + vocabulary.share[np.maximum(place, -1)]
            found[other] -= vocabulary.totals[-1 - place[other]]  # the last share, which they got, is 0
            found, ends = np.concatenate([[0.0], np.cumsum(found)]), np.cumsum(sizes)
            n += sizes.tolist()
            total += (found[ends] - found[ends - sizes]).tolist()
            cuts = np.searchsorted(other, [0, *ends]).tolist()
            rare += [[words[j] for j in other[x:y]] for x, y in zip(cuts, cuts[1:])]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(rare, pa.list_(pa.binary()))], ["n", "total", "rare"])

    return scores


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_words, log_likelihood (the sum) and mean_log_likelihood."""
    small_batches(docs.sparkSession)
    scores = _scorer(docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.weights)))
    first, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    scored = written(docs.select(first.alias("a"), second.alias("b"), scores(F.col(text)).alias("s")).select("a", "b", "s.*"), "scored")
    once = scored.groupBy("a", "b").agg(F.any_value("n").alias("n"), F.any_value("total").alias("total"), F.any_value("rare").alias("rare"))
    shares = once.select("a", "b", F.explode("rare").alias("word")).join(model.counts, "word").groupBy("a", "b").agg(F.sum(F.ln("n")).alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n") > 0, total / F.col("n"))
    found = once.drop("rare").join(shares, ["a", "b"], "left").select("a", "b", F.col("n").alias("n_words"), total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))
    a, b, salt = (apart(docs, name) for name in ("text_a", "text_b", "text_salt"))
    found = found.withColumnsRenamed({"a": a, "b": b}).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = docs.withColumns({a: first, b: second, salt: F.spark_partition_id() % SALTS}).drop("n_words", "log_likelihood", "mean_log_likelihood")
    return keyed.join(found, [a, b, salt], "left").drop(a, b, salt)

"""Toxicity by averaged subword embeddings and a linear softmax.

A text is lower-cased and cut into windows of WINDOW words. Every character
3-, 4- and 5-gram of a word, its boundaries included, is hashed to a bucket
with an embedding; a window is the average of its n-grams' embeddings, and a
two-class softmax over a linear layer scores it. Embeddings and layer are
trained jointly in numpy by Adagrad. A misspelt word shares most n-grams with
its original, so it need not have been seen. A text scores as its worst
window, so length does not dilute a passage; a logistic step fitted on texts
kept out of the training makes that a probability.

Training takes a bounded sample of labelled rows: up to `per_class` texts of
each label with at most `max_chars` characters, in the order of a hash of the
id. Toxic texts are bags: the first epochs take every window of them as toxic,
the later ones only the worst few. One task trains, so the driver holds the
model alone. Scoring takes all texts, whole, in tasks.

Null and empty texts have no window and score as the bias alone. Labels that
are null are left out; an id with several labels takes the largest. Without
labels of both kinds every score is the share of toxic labels (0 if none).
Repeated rows score alike; other columns stay, an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from itemlake.llm.common import small_batches

WINDOW = 4  # words
GRAMS = (3, 4, 5)
BITS = 18  # of a bucket
DIM = 8
PIECE = 1 << 20  # characters that are worked on at once


def _pieces(texts: Iterable[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append((text or "").lower())
        size += len(held[-1])
        if size > PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the window of each, and the text of each window."""
    code = np.frombuffer((" " + " ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    solid = (code > 32) & (code != 0xA0)
    starts = solid[1:] & ~solid[:-1]
    word = np.concatenate([[0], np.cumsum(starts)])  # number of words begun up to here
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = word[at[:-1]]
    words = np.diff(word[at])
    windows = -(-words // WINDOW)
    base = np.cumsum(windows) - windows
    text_of_word = np.repeat(np.arange(len(texts)), words)
    order = np.arange(len(text_of_word)) - first[text_of_word]
    window_of_word = base[text_of_word] + order // WINDOW
    mult, mix = np.uint32(0x01000193), np.uint32(0x9E3779B1)
    h = code[:-1] * mult + code[1:]
    inner = np.ones(len(code), dtype=bool)
    buckets, owners = [], []
    for n in range(3, max(GRAMS) + 1):
        h = h[: len(code) - n + 1] * mult + code[n - 1 :]
        inner = inner[: len(h)] & solid[n - 2 : n - 2 + len(h)]
        if n in GRAMS:
            i = np.flatnonzero(inner)
            buckets.append(((h[i] + np.uint32(n)) * mix) >> np.uint32(32 - BITS))
            owners.append(window_of_word[word[i + 1] - 1])
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owners), np.repeat(np.arange(len(texts)), windows)


@dataclass
class Model:
    """weight[b]: what an n-gram in bucket b adds to its window's average log-odds."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: list[str]) -> np.ndarray:
        """The worst window's log-odds of each text."""
        bucket, owner, text = features(texts)
        out = np.full(len(texts), -np.inf)
        if len(text):
            total = np.bincount(owner, self.weight[bucket], minlength=len(text))
            n = np.bincount(owner, minlength=len(text))
            np.maximum.at(out, text, total / np.maximum(n, 1) + self.bias)
        return np.where(np.isinf(out), self.bias, out)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        found = [self.margins(piece) for piece in _pieces(texts)]
        z = np.concatenate(found) if found else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def fit(texts: list[str], toxic: np.ndarray, share: float, epochs: int = 6, batches: int = 64, rate: float = 1.0, least: int = 5, worst: int = 4, seed: int = 7) -> Model:
    """Train on texts with labels 0 and 1; share: of toxic texts among all labelled ones."""
    if len(set(toxic.tolist())) < 2:
        at = min(max(share, 1e-12), 1 - 1e-12)
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0, float(np.log(at / (1 - at))))
    random = np.random.default_rng(seed)
    kept_out = random.random(len(texts)) < 0.2
    label = toxic[~kept_out]
    pieces = list(_pieces(t for t, out in zip(texts, kept_out) if not out))
    buckets, owners, texts_of, seen = [], [], [], np.zeros(1 << BITS, dtype=np.int32)
    n_windows = n_texts = 0
    for piece in pieces:
        bucket, owner, text = features(piece)
        order = np.argsort(owner, kind="stable")
        buckets.append(bucket[order])
        owners.append((owner[order] + n_windows).astype(np.int32))
        texts_of.append(text + n_texts)
        seen += np.bincount(np.unique(text[owner].astype(np.int64) << BITS | bucket) & (1 << BITS) - 1, minlength=1 << BITS).astype(np.int32)
        n_windows, n_texts = n_windows + len(text), n_texts + len(piece)
    text = np.concatenate(texts_of)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    size = np.bincount(owner, minlength=len(text)).astype(np.float64)
    # an n-gram of fewer than `least` texts carries no weight, as it would tell texts and not words apart
    kept = (seen >= least)[bucket]
    known, place_of = np.flatnonzero(seen >= least), np.cumsum(seen >= least, dtype=np.int32) - 1
    bucket, owner = place_of[bucket[kept]], owner[kept]
    grams = np.bincount(owner, minlength=len(text))
    begin = np.cumsum(grams) - grams
    bag, full = label[text], np.maximum(size, 1)

    emb = random.uniform(-0.05, 0.05, (len(known), DIM))
    layer, bias = random.uniform(-0.5, 0.5, DIM), 0.0
    emb_sq, layer_sq, bias_sq = np.full(len(known), 1e-7), np.full(DIM, 1e-4), 1e-4
    use = grams > 0
    for epoch in range(epochs):
        if epoch >= epochs // 2:  # from now on the worst windows of a toxic text alone are toxic
            z = np.bincount(owner, (emb @ layer)[bucket], minlength=len(text)) / full
            rank = np.lexsort((-z, text))
            place = np.empty(len(text), dtype=np.int64)
            place[rank] = np.arange(len(text)) - np.searchsorted(text[rank], text[rank])
            use = (grams > 0) & ((bag == 0) | (place < worst))
        chosen = random.permutation(np.flatnonzero(use))
        heavy = {y: 0.5 / max(1, (bag[chosen] == y).sum()) for y in (0, 1)}
        for some in np.array_split(chosen, max(1, min(batches, len(chosen) // 16))):
            n = grams[some]
            at = np.repeat(begin[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            b, own = bucket[at], np.repeat(np.arange(len(some)), n)
            z = np.bincount(own, (emb @ layer)[b], minlength=len(some)) / full[some] + bias
            y = bag[some]
            weight = np.where(y == 1, heavy[1], heavy[0])
            delta = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / weight.sum()
            # the softmax's two rows differ by layer; each n-gram's gradient is a multiple of it
            hit = np.bincount(b, (delta / full[some])[own], minlength=len(known))
            g_layer, g_bias = hit @ emb, delta.sum()
            rows = np.flatnonzero(hit)
            emb_sq[rows] += hit[rows] ** 2 * (layer @ layer)
            emb[rows] -= rate * (hit[rows] / np.sqrt(emb_sq[rows]))[:, None] * layer
            layer_sq += g_layer**2
            layer -= rate * 0.1 * g_layer / np.sqrt(layer_sq)
            bias_sq += g_bias**2
            bias -= rate * 0.1 * g_bias / np.sqrt(bias_sq)
    weight = np.zeros(1 << BITS, dtype=np.float32)
    weight[known] = emb @ layer
    model = Model(weight, float(bias))
    z, y = np.concatenate([model.margins(p) for p in _pieces(t for t, out in zip(texts, kept_out) if out)] or [np.empty(0)]), toxic[kept_out]
    if len(set(y.tolist())) == 2:
        model.slope, model.shift = _logistic(z, y, share)
    return model


def _logistic(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift that make z log-odds where a share of texts is toxic (Newton steps, a weak prior)."""
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    mean, scale = z.mean(), z.std() + 1e-9
    x = np.stack([(z - mean) / scale, np.ones(len(z))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labels (id_col, label_col) joined to docs."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    sampled = None
    for label in (0, 1):
        ids = F.broadcast(known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(2 * per_class))
        mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= max_chars).join(ids, "id")
        mine = mine.select(F.lit(label).alias("label"), F.xxhash64("id").alias("place"), "id", "text").orderBy("place", "id").limit(per_class)
        sampled = mine if sampled is None else sampled.union(mine)
    share = total.toxic / max(1, total.n)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            toxic += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        model = fit(texts, np.array(toxic, dtype=np.int64), share)
        numbers = {k: [float(getattr(model, k))] for k in ("bias", "slope", "shift")}
        yield pa.RecordBatch.from_pydict({"weight": [model.weight.tobytes()]} | numbers)

    # the sample is bounded; a task has the memory to train on it that the driver may lack
    small_batches(docs.sparkSession)
    ordered = sampled.repartition(1).sortWithinPartitions("label", "place", "id").select("label", "text")
    found = ordered.mapInArrow(fitted, "weight binary, bias double, slope double, shift double").collect()
    if not found:  # no row, no task
        return fit([], np.empty(0, dtype=np.int64), share)
    return Model(np.frombuffer(found[0].weight, dtype=np.float32), found[0].bias, found[0].slope, found[0].shift)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats

    @F.arrow_udf(DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(t.as_py() for t in texts), pa.float64())

    return docs.withColumn(out, scores(F.col(text_col)))


def held_out(id_col: Column) -> Column:
    """The fold that no training sees: a quarter of all ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))

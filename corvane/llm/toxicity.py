"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed single words, word pairs and pairs with one word between
(lower case).  Training is FTRL-proximal with per-coordinate rates and L1, on at most ``TRAIN_ROWS``
labelled rows and ``TRAIN_FEATURES`` of their features, picked in the order of a hash of their id; both
bounds are parameters, they bound what reaches the driver, and the rest of the data is scored, never
sampled.  L1 leaves few weights, so the model is a sparse vector of at most 2**BITS entries, small
enough to ship to every task.  Scoring is one narrow pass.

Cases: a null or empty text is scored by the bias alone; a very long text is read whole and has at most
2**BITS features (one that is over the bound alone is not trained on, but scored); rows without an id
or label are not used for training; several labels of one id count as toxic if one does; of several
texts of one id the one of the smallest hash is learnt; with no usable label at all every score is 0.0;
an empty table gives an empty result; labels, lang, source and id are never inputs of a score; other
columns pass through ``clean`` with their values, and through ``score`` unless they are named like its
two results in any case.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from corvane.llm.common import fresh, tidied, tidy, whole_text
from corvane.plans.scratch import materialize, release

BITS = 18
TRAIN_ROWS = 12_000
#: Features, over all rows learnt from, that are sent to the driver at most (four bytes each).
TRAIN_FEATURES = 32_000_000
EPOCHS = 6
THRESHOLD = 0.3
#: Words remembered by a worker at most.
MEMORY_WORDS = 200_000

_words = re.compile(r"\w+").findall
_known: dict[str, int] = {}


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers below 2**bits, ascending."""
    words = _words(text.lower())
    if len(_known) > MEMORY_WORDS:
        _known.clear()
    try:
        h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in _known:
                _known[w] = _hash(w)
        h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    pair, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = [h, (h[:-1] * pair) ^ (h[1:] + skip), (h[:-2] * skip) ^ (h[2:] + pair)]
    every = np.concatenate([(m * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits) for m in mixed])
    return np.unique(every.astype(np.int64))


@dataclass
class Model:
    """A sparse weight vector; ``index`` ascending."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w

    def score(self, dense: np.ndarray, f: np.ndarray) -> float:
        return _sigmoid(self.bias + float(dense[f].sum()))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1) -> Model:
    """FTRL-proximal (per-coordinate rates, L1 in closed form).  ``rows`` in a fixed order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    free = size - 1  # the bias has no L1

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        shrink = np.where(f == free, 0.0, l1)
        return np.where(np.abs(zf) <= shrink, 0.0, -(zf - np.sign(zf) * shrink) / ((beta + np.sqrt(n[f])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f = np.append(rows[k][0].astype(np.int64), free)
            w = weights(f)
            g = _sigmoid(float(w.sum())) - rows[k][1]
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - step * w
            n[f] += g * g
    every = np.concatenate([weights(np.arange(a, min(a + (1 << 16), size))) for a in range(0, size, 1 << 16)])
    index = np.flatnonzero(every[:-1])
    return Model(bits, float(every[-1]), index, every[index].astype(np.float32))


def held_out() -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS, train_features: int = TRAIN_FEATURES) -> Model | None:
    """The model of at most ``train_rows`` labelled rows that aren't held out; None without labels."""
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    picked = picked.select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), bits).astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("h"), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "h", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # the ids are at most train_rows, so their side may be broadcast
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    table = rows.select("id", "y", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"id {kind}, y int, h bigint, f array<int>")
    table = materialize(table.groupBy("id", "y").agg(F.min_by("f", "h").alias("f")), "train")
    # at most train_rows slim rows stand in the window
    upto = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = table.select("id", F.sum(F.size("f").cast("long")).over(upto).alias("n")).where(F.col("n") <= train_features).select("id")
    rows = table.join(F.broadcast(within), "id").toArrow().sort_by("id")
    release(table)
    if not rows.num_rows:
        return None
    model = train([(f.values.to_numpy(), int(y.as_py() > 0)) for f, y in zip(rows["f"], rows["y"])], bits)
    del rows
    tidy()  # the driver goes on with other work
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the columns ``score`` and ``predicted`` added (replacing any of these names)."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return _scored(docs.select(*(docs[f"`{c}`"] for c in keep)), model, threshold, "score", "predicted")


def _scored(docs: DataFrame, model: Model | None, threshold: float, score_name: str, predicted_name: str) -> DataFrame:
    if model is None:
        return docs.withColumn(score_name, F.lit(0.0)).withColumn(predicted_name, F.lit(0))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        dense = own.dense()
        for batch in batches:
            s = [own.score(dense, features(t.as_py() or "", own.bits)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*names, score_name])

    scored = docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score_name, DoubleType()))
    return scored.withColumn(predicted_name, (F.col(score_name) >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    score_name, predicted_name = fresh(docs, "_score", "_predicted")
    scored = _scored(docs, fit(docs, labels), threshold, score_name, predicted_name)
    return scored.where(F.col(predicted_name) == 0).drop(score_name, predicted_name)

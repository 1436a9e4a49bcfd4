"""Quality classifier: a factorisation machine.

A text becomes a sparse vector of hashed words and statistics of its
structure. The score is a logistic of a bias, a weight per feature, and the
products of all pairs of features, each weighed by the inner product of two
short vectors. The sum over pairs is half of the square of the sum less the
sum of the squares, per dimension, so that a text costs time linear in its
words.

Training takes a bounded sample of labelled rows; scoring takes every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import whole_text
from dataquay.llm.hashing import hashes_of, runs, words_of

#: Buckets of hashed words, and dimensions of the pairwise vectors.
BUCKETS, DIMENSIONS = 4096, 8
#: Most labelled rows of a class that training takes, lowest hash of the id first.
TRAIN_ROWS = 3000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-4
ACCEPT = 0.7

#: Kinds of bytes: symbols, capitals, digits, marks; 0 for others.
_KIND = np.zeros(256, np.uint8)
for _kind, _signs in enumerate((b"#*$%&|<>{}\\^~=_@", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"), 1):
    _KIND[list(_signs)] = _kind

#: Each statistic is cut at these places; the feature says between which it lies.
CUTS = {
    "words": (5, 20, 50, 100, 400, 2000),
    "word_length": (2.5, 3.5, 4.5, 5.5, 7.0, 10.0),
    "symbols": (0.002, 0.01, 0.03, 0.1, 0.3),
    "upper": (0.005, 0.02, 0.05, 0.1, 0.3, 0.7),
    "digits": (0.002, 0.01, 0.05, 0.15, 0.4),
    "marks": (0.005, 0.02, 0.05, 0.1, 0.2),
    "distinct": (0.1, 0.25, 0.4, 0.6, 0.8, 0.95),
    "top_word": (0.02, 0.05, 0.1, 0.2, 0.4),
    "repeated_lines": (0.01, 0.1, 0.3, 0.6),
    "line_words": (2, 5, 10, 30, 100),
    "repeated_pairs": (0.05, 0.15, 0.3, 0.5, 0.8),
}
_FIRST = dict(zip(CUTS, np.cumsum([0] + [len(c) + 1 for c in CUTS.values()])[:-1].tolist()))
STATISTICS = sum(len(c) + 1 for c in CUTS.values())
FEATURES = BUCKETS + STATISTICS


def structure(raw: bytes, words: list[bytes], counts: np.ndarray, pairs: int) -> dict[str, float]:
    """Statistics of a text: its bytes, words, how often each distinct word occurs, and distinct pairs of neighbours."""
    n = len(words)
    letters = max(1, sum(map(len, words)))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=5)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "words": n, "word_length": letters / max(1, n), "symbols": kinds[1] / letters, "upper": kinds[2] / letters,
        "digits": kinds[3] / letters, "marks": kinds[4] / letters, "distinct": len(counts) / max(1, n),
        "top_word": float(counts.max()) / n if n else 0.0, "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "line_words": n / max(1, len(lines)), "repeated_pairs": 1 - pairs / (n - 1) if n > 1 else 0.0,
    }


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words by root of their counts, scaled to length 1, and one sign per statistic."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(text)
    hashes = hashes_of(words)
    distinct, counts = np.unique(hashes, return_counts=True)
    found = np.bincount((distinct % np.uint64(BUCKETS)).astype(np.int64), counts, BUCKETS)
    where = np.flatnonzero(found)
    values = np.sqrt(found[where])
    values /= max(1e-12, math.sqrt(float(values @ values)))
    facts = structure(raw, words, counts, len(np.unique(runs(hashes, 2))))
    signs = [BUCKETS + _FIRST[name] + sum(facts[name] > c for c in cuts) for name, cuts in CUTS.items()]
    return np.concatenate([where, signs]), np.concatenate([values, np.full(len(signs), 0.5)])


class Machine(NamedTuple):
    """Bias, weights (FEATURES), vectors (FEATURES x DIMENSIONS)."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        parts = self.vectors[index] * value[:, None]
        total = parts.sum(axis=0)
        return float(self.bias + self.weights[index] @ value + 0.5 * (total @ total - (parts * parts).sum()))

    def score(self, text: str | None) -> float:
        z = self.logit(*features(text))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 5) -> Machine:
    """AdaGrad over shuffled batches on the logistic loss; classes weigh the same. Without two classes: their share."""
    y = np.array(labels, np.float64)
    weights, vectors = np.zeros(FEATURES), np.random.default_rng(seed).normal(0, 0.05, (FEATURES, DIMENSIONS))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Machine(math.log((share + 1e-3) / (1 - share + 1e-3)), weights, np.zeros_like(vectors))
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    order = np.random.default_rng(seed + 1)
    bias, g_bias = 0.0, 1e-8
    g_w, g_v = np.full(FEATURES, 1e-8), np.full((FEATURES, DIMENSIONS), 1e-8)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(y))
        for a in range(0, len(y), BATCH):
            batch = shuffled[a:a + BATCH]
            d_w, d_v, d_bias = np.zeros(FEATURES), np.zeros((FEATURES, DIMENSIONS)), 0.0
            for i in batch:
                index, value = rows[i]
                parts = vectors[index] * value[:, None]
                total = parts.sum(axis=0)
                z = bias + weights[index] @ value + 0.5 * (total @ total - (parts * parts).sum())
                slope = share[i] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y[i]) / len(batch)
                d_bias += slope
                d_w[index] += slope * value
                d_v[index] += slope * value[:, None] * (total - parts)
            d_w += DECAY * weights
            d_v += DECAY * vectors
            g_bias += d_bias**2
            g_w += d_w**2
            g_v += d_v**2
            bias -= RATE * d_bias / math.sqrt(g_bias)
            weights -= RATE * d_w / np.sqrt(g_w)
            vectors -= RATE * d_v / np.sqrt(g_v)
    return Machine(float(bias), weights, vectors)


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learned from. A null id counts as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % 4) == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Machine:
    """Learn from `train_rows` labelled rows of each class at most, whatever the number of rows.

    Ids that are held out or have no id, and ids whose labels differ or are
    null, are left out; of documents with one id each counts until the bound is met.
    """
    told = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"),
    ).where("label = other AND label IN (0, 1)").select("doc_id", "label", F.xxhash64(F.lit("train"), "doc_id").alias("place"))
    best = lambda rows, label: rows.where(F.col("label") == label).orderBy("place", "doc_id").limit(train_rows)
    chosen = F.broadcast(best(told, 0).unionAll(best(told, 1)))  # 2 * train_rows rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).join(chosen, "doc_id")
    found = texts.mapInPandas(_vectors, "doc_id long, label int, place long, i array<int>, v array<double>")
    rows = sorted((r for k in (0, 1) for r in best(found, k).collect()), key=lambda r: (r["place"], r["doc_id"], r["i"], r["v"]))
    return fit([(np.array(r["i"]), np.array(r["v"])) for r in rows], [r["label"] for r in rows])


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [features(t) for t in batch["text"]]
        out = batch[["doc_id", "label", "place"]].copy()
        out["i"] = [x.astype(np.int32) for x, _ in found]
        out["v"] = [x for _, x in found]
        yield out


def score(docs: DataFrame, machine: Machine, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """`docs` as a struct `row`, with score and predicted. Null texts are empty; empty texts get a score too.

    The score of a text depends on the text alone.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([machine.score(t) for t in texts], dtype="float64")

    out = docs.select(F.struct("*").alias("row"), scored(whole_text(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= accept, 1).otherwise(0))

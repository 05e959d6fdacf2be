"""Quality classifier: supervised subword embeddings with averaged vectors, softmax output and numpy SGD.

The features of a text are hashed words, hashed character n-grams inside words (with their boundaries), and word
bigrams; a bigram of twice the same word is hashed as that pattern, whatever the word, as repetition itself is what
such a bigram shows. Case is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import code_points, gram_hashes, mixed, segment_sums, text_slices
from .labelled import held_out, labelled_sample
from .workspace import extended

_SPACES = np.array([9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)
REPEAT = np.uint32(0x7A11F00D)


def features(texts: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature and the text that it belongs to, in no order within a text."""
    points, bounds = code_points(texts)
    blank = np.isin(points, _SPACES)
    # words: runs without blanks; a pad stands at both ends of every text, so no word crosses texts
    edge = np.diff(blank.astype(np.int8))
    begin, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    # a word's hash from prefix sums of odd powers, made free of its place by the inverse power
    odd, inverse = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    powers = np.full(len(points), odd, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers, out=prefix[1:])
    back = np.full(len(points), inverse, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    words64 = (prefix[end] - prefix[begin]) * back[begin]
    words = (words64 ^ (words64 >> np.uint64(32))).astype(np.uint32)
    owner = np.searchsorted(bounds, begin, side="right") - 1
    pair_owner = owner[1:][owner[1:] == owner[:-1]]
    a, b = words[:-1][owner[1:] == owner[:-1]], words[1:][owner[1:] == owner[:-1]]
    pairs = np.where(a == b, REPEAT, a * np.uint32(0x01000193) ^ b)
    found, owners = [mixed(words, 0xA11CE), mixed(pairs, 0xB0B)], [owner, pair_owner]
    crossed = np.concatenate([[0], np.cumsum(blank)])
    of_char = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for n, h in gram_hashes(points, orders):
        inner = crossed[n - 1 : n - 1 + len(h)] - crossed[1 : 1 + len(h)]  # blanks strictly inside the gram
        good = np.flatnonzero(inner == 0) if n > 2 else np.arange(len(h))
        good = good[of_char[good] == of_char[good + n - 1]]
        found.append(mixed(h[good], n * 0x1234567))
        owners.append(of_char[good])
    return np.concatenate(found) & np.uint32(buckets - 1), np.concatenate(owners)


@dataclass
class SubwordClassifier:
    """Bucket vectors and the softmax layer; for scoring they fold into one number a bucket."""

    orders: tuple[int, ...]
    buckets: int
    folded: np.ndarray
    bias: float

    @classmethod
    def fit(cls, texts: list[str], y: list[int], orders: tuple[int, ...] = (3, 4), buckets: int = 1 << 18, width: int = 8, epochs: int = 4, least_steps: int = 4000, rate: float = 0.5, seed: int = 7) -> SubwordClassifier:
        """Stochastic gradient descent, a text at a time, over vectors of the features' mean; the rate falls linearly to 0. Few texts get more epochs, for `least_steps` in all."""
        if len(set(y)) < 2:
            share = float(np.mean(y)) if y else 0.5
            return cls(orders, buckets, np.zeros(buckets, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
        output, bias = np.zeros((2, width), np.float32), np.zeros(2, np.float32)
        bags = []
        for text in texts:
            slots, counts = np.unique(features([text], orders, buckets)[0], return_counts=True)
            bags.append((slots, (counts / max(counts.sum(), 1)).astype(np.float32)))
        epochs = max(epochs, -(-least_steps // len(texts)))
        steps, done = epochs * len(texts), 0
        for _ in range(epochs):
            for k in rng.permutation(len(texts)):
                slots, shares = bags[k]
                mean = shares @ vectors[slots] if len(slots) else np.zeros(width, np.float32)
                z = output @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[k]] -= 1  # the gradient of the loss by z
                lr = rate * (1 - done / steps)
                back = p @ output
                output -= lr * np.outer(p, mean)
                bias -= lr * p
                if len(slots):
                    # a feature's step is by its share; the factor keeps rare features moving in long texts
                    vectors[slots] -= (lr * 20) * shares[:, None] * back[None, :]
                done += 1
        return cls(orders, buckets, (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))

    def score(self, texts: list[str]) -> np.ndarray:
        """Softmax probability of label 1; a text without features has the bias alone."""
        slots, owner = features(texts, self.orders, self.buckets)
        total = np.bincount(owner, weights=self.folded[slots], minlength=len(texts))
        counts = np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(counts, 1) + self.bias, -50, 50)))


def score_texts(docs: DataFrame, model, column: str) -> DataFrame:
    """docs with `column` (double): model.score of every whole text. No shuffle; null text scores as empty; extra columns stay, one of that name is replaced."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != column]
    base = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(texts) for _, texts in text_slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*kept, column])

    return base.mapInArrow(run, extended(base, (column, "double")))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> SubwordClassifier:
    """Learned from at most `per_class` rows of each class that are not held out."""
    return SubwordClassifier.fit(*labelled_sample(docs, labels, "quality", per_class))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2500, column: str = "quality_score") -> DataFrame:
    """docs with `column`, the quality of every whole text, 0 to 1; no shuffle.

    With no label of one class the score is the same for all: that class's smoothed share (0.5 without labels). Null
    and empty texts have the model's bias. Texts of any length are scored whole, a slice of a batch at a time. Repeated
    rows and ties are each scored; an empty table gives an empty result; extra columns stay, one named `column` is
    replaced.
    """
    return score_texts(docs, fit_quality(docs, labels, per_class), column)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of documents. A null doc_id is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))

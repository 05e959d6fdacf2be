"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import code_points, gram_ends, gram_hashes, mixed
from .labelled import held_out, labelled_sample
from .subword_quality import score_texts


def _grams(texts: list[str], orders: tuple[int, ...], buckets: int):
    """(slots, owner) of every n-gram of the lower-cased texts, order by order; a text's ends count as blanks."""
    points, bounds = code_points([t.lower() for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for n, h in gram_hashes(points, orders):
        slots = mixed(h, n * 0x2545F491 & 0xFFFFFFFF) & np.uint32(buckets - 1)
        ends = gram_ends(bounds, n)
        yield slots, owner, ends[ends < len(slots)]


@dataclass
class NaiveBayesLinear:
    """`weight` holds ratio times learned weight for each bucket; a feature counts once a text."""

    orders: tuple[int, ...]
    buckets: int
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, texts: list[str], y: list[int], orders: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 21, most_features: int = 40_000, smoothing: float = 0.5, penalty: float = 1e-3, steps: int = 300) -> NaiveBayesLinear:
        """Features are the `most_features` buckets of the largest naive Bayes ratio in standard errors; the weights are a penalised logistic fit on ratio-scaled presence, classes balanced."""
        y = np.asarray(y, np.float64)
        pos, neg = int(y.sum()), int((1 - y).sum())
        if not pos or not neg:
            share = (pos + 1e-3) / (pos + neg + 2e-3)
            return cls(orders, buckets, np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
        bags, df = [], np.zeros((2, buckets), np.float64)
        for text, label in zip(texts, y):
            parts = []
            for slots, _, ends in _grams([text], orders, buckets):
                keep = np.ones(len(slots), bool)
                keep[ends] = False
                parts.append(slots[keep])
            bag = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)
            bags.append(bag)
            df[int(label)][bag] += 1
        ratio = np.log((df[1] + smoothing) / (pos + 2 * smoothing)) - np.log((df[0] + smoothing) / (neg + 2 * smoothing))
        error = np.sqrt(1 / (df[1] + smoothing) + 1 / (df[0] + smoothing))
        strength = np.where(df.sum(0) >= 4, np.abs(ratio) / error, 0)
        chosen = np.flatnonzero(strength > 3.0)
        chosen = chosen[np.argsort(-strength[chosen], kind="stable")[:most_features]]
        place = np.full(buckets, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        rows = [p[p >= 0] for p in (place[b] for b in bags)]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        column = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), counts)
        scale = ratio[chosen]
        value = scale[column]
        share = np.where(y == 1, 0.5 / pos, 0.5 / neg)
        w, b = np.zeros(len(chosen)), 0.0
        # full-batch Adam: the fit is the same on every run
        m, v, step = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0.05
        for t in range(1, steps + 1):
            z = np.bincount(row, weights=value * w[column], minlength=len(rows)) + b
            g = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
            grad = np.append(np.bincount(column, weights=value * g[row], minlength=len(chosen)) + penalty * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            change = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - change[:-1], b - change[-1]
        weight = np.zeros(buckets, np.float32)
        weight[chosen] = scale * w
        return cls(orders, buckets, weight, float(b))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; an empty text has the bias alone."""
        total, hot = np.full(len(texts), self.bias), self.weight != 0
        keys = []
        for slots, owner, ends in _grams(texts, self.orders, self.buckets):
            hit = hot[slots]
            hit[ends] = False
            at = np.flatnonzero(hit)
            keys.append(owner[at].astype(np.int64) * self.buckets + slots[at])
        once = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        total += np.bincount(once // self.buckets, weights=self.weight[once % self.buckets], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> DataFrame:
    """docs with `toxicity` (0 to 1), whole texts, no shuffle.

    Learned from at most `per_class` rows of each class that are not held out. Null and empty texts have the model's
    bias; with no label of one class all scores are that class's smoothed share. Repeated rows are each scored, extra
    columns stay, and a column named toxicity is replaced.
    """
    model = NaiveBayesLinear.fit(*labelled_sample(docs, labels, "toxic", per_class))
    return score_texts(docs, model, "toxicity")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of documents. A null doc_id is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))

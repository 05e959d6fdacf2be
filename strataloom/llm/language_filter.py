"""Language identification by bit-sliced Bloom filters over character n-grams.

Each slot of a filter is a word with one bit for each language. A lookup ANDs the words of a gram's k slots, which
returns all languages that contain the gram at once. A language's score is the count of grams that carry its bit,
corrected by the rate at which its bit is set in all k slots by chance. Texts with hardly a known 4-gram are judged by
a second filter of grams of one to three characters as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import code_points, gram_ends, gram_hashes, mixed, segment_sums, text_slices
from .labelled import held_out, language_sample
from .workspace import extended

UNKNOWN = "und"
#: A text whose best language has fewer hits than this is judged by shorter grams too.
FEW = 5


@dataclass
class LanguageFilters:
    """Learned filters; `fit` is the only way to make them."""

    languages: list[str]
    orders: tuple[int, ...]
    slots: int
    salts: tuple[int, ...]
    words: list[np.ndarray] = field(default_factory=list)  # for each 64 languages, one word a slot
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))
    short: LanguageFilters | None = None

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], orders: tuple[int, ...] = (4,), slots: int = 1 << 20, hashes: int = 2, least_share: float = 0.02) -> LanguageFilters:
        """A language's filter holds the grams that at least `least_share` of its sampled texts contain (two texts at least, where there are so many)."""
        known = sorted(set(langs))
        model = cls(known, orders, slots, tuple(0x51ED2701 * (k + 1) & 0xFFFFFFFF for k in range(hashes)))
        model.words = [np.zeros(slots, np.uint64) for _ in range(0, max(len(known), 1), 64)]
        for code, lang in enumerate(known):
            own = [t for t, x in zip(texts, langs) if x == lang]
            seen = []
            for text in own:
                points, bounds = code_points([text.lower()])
                seen.append(np.unique(np.concatenate([h[: max(len(points) - n + 1, 0)] ^ np.uint32(n) for n, h in gram_hashes(points, orders)] or [np.zeros(0, np.uint32)])))
            grams, df = np.unique(np.concatenate(seen), return_counts=True)
            grams = grams[df >= max(min(2, len(own)), least_share * len(own))]
            for salt in model.salts:
                model.words[code // 64][mixed(grams, salt) & np.uint32(slots - 1)] |= np.uint64(1 << (code % 64))
        fill = [np.count_nonzero(model.words[c // 64] & np.uint64(1 << (c % 64))) / slots for c in range(len(known))]
        model.chance = np.array(fill) ** hashes
        if min(orders) > 3 and known:
            model.short = cls.fit(texts, langs, (1, 2, 3), slots, hashes, least_share)
        return model

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each text, and for each language those that carry its bit, corrected for chance."""
        points, bounds = code_points([t.lower() for t in texts])
        total, found = np.zeros(len(texts)), np.zeros((len(self.languages), len(texts)))
        for n, h in gram_hashes(points, self.orders):
            h = h ^ np.uint32(n)
            ends = gram_ends(bounds, n)
            slots = [mixed(h, s) & np.uint32(self.slots - 1) for s in self.salts]
            total += np.maximum(np.diff(bounds) - n + 1, 0)
            for w, table in enumerate(self.words):
                masks = table[slots[0]]
                for s in slots[1:]:
                    masks &= table[s]
                masks[ends[ends < len(masks)]] = 0
                for code in range(64 * w, min(64 * (w + 1), len(self.languages))):
                    found[code] += segment_sums(((masks >> np.uint64(code % 64)) & np.uint64(1)).astype(np.uint8).astype(np.float32), bounds)
        corrected = np.maximum(found - self.chance[:, None] * total, 0) / (1 - self.chance[:, None]) if len(self.languages) else found
        return total, corrected

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and number of grams of each text. The score is the winner's share of the two largest counts, 0.5 to 1; 0 with no letter or no hit. A tie goes to the first name."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)  # nothing was looked up
        grams, counts = self.hits(texts)
        few = np.flatnonzero(counts.max(axis=0) < FEW)
        if self.short and len(few):
            counts[:, few] += self.short.hits([texts[k] for k in few.tolist()])[1]
        best = counts.argmax(axis=0)
        top = counts[best, np.arange(len(texts))]
        second = np.partition(counts, -2, axis=0)[-2] if len(self.languages) > 1 else np.zeros(len(texts))
        score = np.where(top > 0, top / np.maximum(top + second, 1e-12), 0.0)
        known = [any(map(str.isalpha, t)) for t in texts]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0), grams.astype(np.int64)


def detect_languages(docs: DataFrame, per_language: int = 1500, model: LanguageFilters | None = None, learn_from: DataFrame | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "n_grams")) -> DataFrame:
    """docs with lang_pred, score and n_grams (grams looked up, as many as the text has), or other names; whole texts, no shuffle.

    The filters are learned from at most `per_language` rows of each language of `learn_from` (docs by default) that
    are not held out, by text and lang alone. A null or letterless text gets `und` and 0, as does every text when
    there is nothing to learn from. Repeated rows are each answered; texts of any length are read whole, a slice of a
    batch at a time; extra columns are kept, and columns of docs with the three names are replaced.
    """
    spark = ship(docs.sparkSession)
    model = model or LanguageFilters.fit(*language_sample(docs if learn_from is None else learn_from, per_language))
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in names]
    base = docs.select(*kept)
    schema = extended(base, *zip(names, ("string", "double", "long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.predict(texts) for _, texts in text_slices(batch.column("text"))]
            langs = [x for p in parts for x in p[0]]
            scores, grams = (np.concatenate([p[k] for p in parts]) if parts else [] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(grams, pa.int64())], names=[*kept, *names])

    return base.mapInArrow(run, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of documents. A null doc_id is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = detect_languages(docs.select("doc_id", "text"), learn_from=docs)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

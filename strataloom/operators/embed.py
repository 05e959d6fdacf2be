"""Embedding chunks: any batch embedder as an Arrow function, and a hashing embedder that needs no model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship


Vectors = list[list[float]]


class HashingEmbedder:
    """Signed feature hashing of a text's lower-case words, at length 1. The same text gives the same vector everywhere."""

    def __init__(self, dimensions: int = 256):
        self.dimensions, self.model = dimensions, f"hashing-{dimensions}"

    def embed_texts(self, texts: list[str]) -> Vectors:
        out = np.zeros((len(texts), self.dimensions))
        for row, t in zip(out, texts):
            for word in re.findall(r"[a-z0-9]{2,}", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", t).lower()):
                h = zlib.crc32(word.encode())
                row[h % self.dimensions] += 1 if h & 0x80000000 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length == 0, 1, length)).tolist()

    def embed(self, text: str) -> list[float]:
        return self.embed_texts([text])[0]


def embed_column(df: DataFrame, column: str, make: Callable, into: str = "embedding", batch: int = 64, tries: int = 3) -> DataFrame:
    """df with the vectors of a text column. `make` builds the embedder once a task; a batch that fails is tried again."""
    ship(df.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != into) + f", `{into}` array<float>"
    kept = [c for c in df.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for b in batches:
            texts, vectors = [t or "" for t in b.column(column).to_pylist()], []
            for k in range(0, len(texts), batch):
                for attempt in range(tries):
                    try:
                        vectors += embedder.embed_texts(texts[k : k + batch])
                        break
                    except Exception:
                        if attempt + 1 == tries:
                            raise
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*kept, into])

    return df.select(*kept).mapInArrow(run, schema)

"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over a window of characters sets chunk ends by content, so copies and shared passages give equal
chunks wherever they stand. A chunk is encoded once in a Python worker, by itself. The ids near a chunk's two ends are
not to be trusted, as words and special strings may run over them. A join is repaired by encoding a window around it
again: the window's first ids must be the left chunk's own there, and its last ids the right chunk's. Where they are
not, the window is widened and encoded again, until both sides agree exactly; a chunk in which no window agrees is
encoded together with its neighbour. A window begins and ends at a cut (white space after a character that is none),
which no pre-token spans in any context (see bpe_units), so ids that agree from a cut on go on agreeing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .arrays import text_slices
from .bpe_units import WHITE, IdsEncoder, Memo, byte_letters, worker_encoder
from .workspace import extended

WINDOW, LEAST, MEAN_BITS, MOST = 32, 256, 10, 8192
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
#: Characters that a window reaches into each of the two chunks at first.
REACH = 24


def chunk_ends(text: str) -> list[int]:
    """Ends of the text's chunks; about 2**MEAN_BITS characters after LEAST, MOST at most."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    # sum of the window's characters times falling powers, from prefix sums of characters times powers of the inverse
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    down, up = np.full(n, inverse, np.uint64), np.full(n, _ODD, np.uint64)
    down[0] = up[0] = 1
    np.multiply.accumulate(down, out=down)
    np.multiply.accumulate(up, out=up)
    prefix = np.cumsum(points * down)
    rolled = prefix[WINDOW - 1 :].copy()
    rolled[1:] -= prefix[:-WINDOW]
    rolled *= up[WINDOW - 1 :]
    marks = (np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW).tolist()
    ends, last = [], 0
    for m in [*marks, n]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or m == n:
            ends.append(m)
            last = m
    return ends if ends[-1] == n else [*ends, n]


def cut_before(text: str, end: int) -> int:
    """The last cut of text below `end`, or 0."""
    for k in range(min(end, len(text)) - 1, 0, -1):
        if text[k] in WHITE and text[k - 1] not in WHITE:
            return k
    return 0


def cut_after(text: str, start: int) -> int:
    """The first cut of text from `start` on, or its length."""
    found = _CUT.search(text, start)
    return found.start() if found else len(text)


def size_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class ChunkCodec:
    """Encodes and decodes whole texts for one Python worker.

    Counted are chunks (`reused`, `encoded`, and the characters of both), joins, windows encoded for them (one a join
    if the first agrees), and chunks that were encoded with a neighbour (`merged`).
    """

    def __init__(self, path: str, most_chunks: int = 20_000):
        self.units = IdsEncoder(path)
        self.chunks = Memo(lambda key: self.alone(self.missing.pop(key)), most_chunks)
        self.missing: dict[bytes, str] = {}
        self.reused = self.encoded = self.reused_chars = self.encoded_chars = self.joins = self.windows = self.merged = 0
        size = self.units.size
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_of = [b""] * size
        for token, i in self.units.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.digits = np.zeros((size, len(str(size)) + 1), np.uint8)
        for i in range(size):
            text = f"{i},".encode()
            self.digits[i, : len(text)] = list(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.units.encode(text), "<u4")

    def alone(self, chunk: str) -> np.ndarray:
        self.encoded += 1
        self.encoded_chars += len(chunk)
        return self.ids(chunk)

    def chunk(self, chunk: str) -> np.ndarray:
        """Ids of a chunk by itself, from memory where it was met before."""
        key = hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if self.chunks.lacks(key):
            self.missing[key] = chunk
        else:
            self.reused += 1
            self.reused_chars += len(chunk)
        ids = self.chunks[key]
        self.missing.pop(key, None)
        return ids

    def joined(self, left: str, left_ids: np.ndarray | None, right: str, right_ids: np.ndarray) -> np.ndarray:
        """Ids of left + right, given each side's own: encode a window around the join, widened until both sides agree.

        Without left_ids the window begins where left does.
        """
        self.joins += 1
        reach = REACH
        while True:
            a, b = cut_before(left, len(left) - reach) if left_ids is not None else 0, cut_after(right, reach)
            if a == 0 and b == len(right):
                self.merged += 1
                return self.ids(left + right)
            self.windows += 1
            window = self.ids(left[a:] + right[:b])
            sizes = np.cumsum(self.lengths[window])
            # where the parts' own ids end at the cut, and how long each side's part of the window is, in bytes
            tail, head = size_of(left[a:]), size_of(right[:b])
            own = np.cumsum(self.lengths[left_ids[::-1]]) if a else np.zeros(0, np.int64)
            keep = len(left_ids) - 1 - int(np.searchsorted(own, tail)) if a else 0
            if a and (keep < 0 or own[len(left_ids) - 1 - keep] != tail):
                reach *= 2
                continue
            ends = np.cumsum(self.lengths[right_ids])
            drop = int(np.searchsorted(ends, head)) + 1 if b < len(right) else len(right_ids)
            if b < len(right) and ends[drop - 1] != head:
                reach *= 2
                continue
            # agreement: at least one unit on each side has the same ids in its chunk and in the window
            inner_left, inner_right = cut_after(left, a + 1), cut_before(right, b)
            first = size_of(left[a:inner_left]) if a and inner_left < len(left) else 0
            last = size_of(right[inner_right:b]) if b < len(right) and inner_right else 0
            p = int(np.searchsorted(sizes, first, side="right")) if first else 0
            q = len(window) - int(np.searchsorted(sizes, tail + head - last, side="right")) if last else 0
            good = (a == 0 or first) and (b == len(right) or last)
            good = good and (not first or (sizes[p - 1] == first and np.array_equal(window[:p], left_ids[keep : keep + p])))
            good = good and (not last or np.array_equal(window[len(window) - q :], right_ids[drop - q : drop]))
            if good:
                return np.concatenate([left_ids[:keep], window, right_ids[drop:]]) if a else np.concatenate([window, right_ids[drop:]])
            reach *= 2

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit bytes."""
        ends = chunk_ends(text)
        if not ends:
            return b""
        # `left` is what the next window may reach into: what follows the last cut that is settled
        left = text[: ends[0]]
        left_ids, done = self.chunk(left), []
        for start, end in zip(ends, ends[1:]):
            right = text[start:end]
            stop = cut_after(right, REACH)
            if stop == len(right):  # nothing to agree on: encoded with what follows, so a text without cuts is encoded once
                left, left_ids = left + right, None
                self.merged += 1
                continue
            ids = self.joined(left, left_ids, right, self.chunk(right))
            # everything before a cut in the right chunk is final; the rest may be reached again
            own, back = np.cumsum(self.lengths[ids[::-1]]), size_of(right[stop:])
            k = int(np.searchsorted(own, back)) + 1
            if own[k - 1] == back:
                done.append(ids[: len(ids) - k])
                left, left_ids = right[stop:], ids[len(ids) - k :]
            else:
                left, left_ids = left + right, ids
        if left_ids is None:
            left_ids = self.ids(left)
        done.append(left_ids)
        return np.concatenate(done).astype("<u4", copy=False).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        flat = self.digits[ids].ravel()
        return flat[flat != 0].tobytes()[:-1]


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, on request, ids (array of int) and decoded (text).

    Whole texts; ids as the library gives them with its special strings recognised and none added; decoded is the text
    of the ids. No shuffle: a document's chunks are looked up in its worker's memo, which is bounded, so that memory
    does not grow with the corpus. Null text counts as empty: no ids. Extra columns stay, those named are replaced.
    """
    ship(docs.sparkSession)
    kind = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {})
    kept = [c for c in docs.columns if c not in kind]
    base = docs.select(*kept)
    sql = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": T.ArrayType(T.IntegerType()), "decoded": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_encoder(("chunks", vocabulary), lambda: ChunkCodec(vocabulary))
        for batch in batches:
            made: dict[str, list] = {c: [] for c in kind}
            for _, texts in text_slices(batch.column("text")):
                for text in texts:
                    ids = np.frombuffer(codec.encode(text), "<u4")
                    decoded = codec.decode(ids)
                    made["n_tokens"].append(len(ids))
                    made["ids_sha256"].append(hashlib.sha256(codec.decimals(ids)).hexdigest())
                    made["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        made["ids"].append(ids.astype(np.int32))
                        made["decoded"].append(decoded)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[c], t) for c, t in kind.items())], names=[*kept, *kind])

    return base.mapInArrow(run, extended(base, *((c, sql[c]) for c in kind)))


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text of its ids column; null ids give null."""
    ship(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != into]
    base = encoded.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_encoder(("chunks", vocabulary), lambda: ChunkCodec(vocabulary))
        for batch in batches:
            texts = [None if x is None else codec.decode(np.asarray(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, into])

    return base.mapInArrow(run, extended(base, (into, "string")))


def op4_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")

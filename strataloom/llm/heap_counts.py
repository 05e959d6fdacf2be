"""Token counts by heap-and-linked-list byte-pair merging, without ids.

The symbols of a pre-token are a linked list; a heap holds its adjacent pairs by rank and place. The least is popped,
checked to be still what it was, and merged; the pairs that the merge makes are pushed. The count is the initial
symbols minus the merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .arrays import text_slices
from .bpe_units import PATTERN, PLAIN_UNIT, RARE, WHITE, Memo, UnitEncoder, byte_letters, load_tokenizer, worker_encoder
from .workspace import extended


class HeapCounter:
    """Counts the tokens of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only a plain byte-level BPE file can be counted")
        # symbols as small integers: the 256 bytes first, then the product of each merge
        number = {letter: b for b, letter in enumerate(byte_letters())}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.made.append(number.setdefault(a + b, len(number)))
            self.ranks.setdefault(number[a] << 32 | number[b], rank)
        self.known = Memo(self.count_word, 200_000)
        self.added = {t["content"]: 1 for t in spec["added_tokens"]}
        # \s as the library has it, not as Python does. Units with characters outside common blocks are split by the
        # library itself, as its table of letters is of another version of Unicode than Python's.
        self.library = load_tokenizer(path).pre_tokenizer
        self.words = regex.compile(PATTERN.replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]"))

    def count_word(self, word: str) -> int:
        """Initial symbols minus merges of one pre-token. A heap entry is rank * n + place, so ties go to the left."""
        symbols = list(word.encode("utf-8", "surrogatepass"))
        n = len(symbols)
        if n < 2:
            return n
        rank_of, made, push, pop = self.ranks.get, self.made, heapq.heappush, heapq.heappop
        heap = [r * n + k for k, r in enumerate([rank_of(a << 32 | b) for a, b in zip(symbols, symbols[1:])]) if r is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = 0
        while heap:
            rank, k = divmod(pop(heap), n)
            right = after[k]
            if right >= n or symbols[k] < 0 or rank_of(symbols[k] << 32 | symbols[right]) != rank:
                continue  # one of the two was merged away since
            new = symbols[k] = made[rank]
            symbols[right] = -1
            beyond = after[k] = after[right]
            merged += 1
            if beyond < n:
                before[beyond] = k
                r = rank_of(new << 32 | symbols[beyond])
                if r is not None:
                    push(heap, r * n + k)
            left = before[k]
            if left >= 0:
                r = rank_of(symbols[left] << 32 | new)
                if r is not None:
                    push(heap, r * n + left)
        return n - merged

    def count_unit(self, unit: str) -> int:
        plain = PLAIN_UNIT.match(unit)
        if plain:
            word, marks, line, more = plain.groups()
            known = self.known
            count = known[word] + (known[marks] if marks else 0)
            return count + (1 + known[line[1:]] if line else 0) + (known[more] if more else 0)
        if RARE.search(unit):
            return sum(self.known[unit[a:b]] for _, (a, b) in self.library.pre_tokenize_str(unit))
        return sum(map(self.known.__getitem__, self.words.findall(unit)))

    def encoder(self) -> UnitEncoder:
        return UnitEncoder(self.count_unit, self.added)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit), for whole texts and without a shuffle.

    Counts of units are kept in a memo of bounded size in each Python worker; units above 256 characters are counted
    each time, and a very long text costs memory in proportion to itself. A null text counts as empty: 0 bytes,
    0 tokens. Repeated rows are each counted; extra columns stay, those of the three names are replaced.
    """
    ship(docs.sparkSession)
    named = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in named]
    base = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(("count", vocabulary), lambda: HeapCounter(vocabulary).encoder())
        for batch in batches:
            counts, sizes = [], []
            for _, texts in text_slices(batch.column("text")):
                counts += [sum(encoder.parts(t)) for t in texts]
                sizes += [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=[*kept, *named])

    return base.mapInArrow(run, extended(base, ("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token count of every whole text of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")

"""Best-fit packing of documents into sequences, with certified lower bounds.

Pieces are packed by best-fit decreasing within partitions. Dual-feasible functions give a lower bound on each
partition's bins; a partition that meets its bound keeps all but its emptier bins. Partitions with a gap give up all
bins that are not full. Partitions exchange these pieces and run best-fit decreasing again, until one holds all that
is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .arrays import sorted_runs, text_slices
from .bpe_units import IdsEncoder, worker_encoder
from .workspace import Workspace, extended

END_OF_DOCUMENT = 0
PIECE_COLUMNS = ("piece", "start", "length", "ids_crc32")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than capacity."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)]
    return [(s, (first if s == 0 else capacity)) for s in starts]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for whole texts: their ids, then id 0. No shuffle. Null text: id 0 alone."""
    ship(docs.sparkSession)
    base = docs.select("doc_id", "text")
    schema = extended(base.select("doc_id"), ("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"))
    end = np.array([END_OF_DOCUMENT], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(("ids", vocabulary), lambda: IdsEncoder(vocabulary))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for first, texts in text_slices(batch.column("text")):
                for k, text in enumerate(texts):
                    ids = memoryview(encoder.encode(text) + end)
                    for p, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        row.append(first + k)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", *PIECE_COLUMNS])

    return base.mapInArrow(run, schema)


def dual_feasible_bound(histogram: np.ndarray, capacity: int) -> int:
    """The best lower bound on bins over three families of dual-feasible functions. histogram[s] counts pieces of size s.

    Identity; sizes above capacity - e count whole and sizes below e not at all (Martello and Toth); and the rounding
    functions u_k (Fekete and Schepers), for k up to 20.
    """
    sizes = np.arange(len(histogram), dtype=np.int64)
    best = -(-int((histogram * sizes).sum()) // capacity)
    count, mass = np.cumsum(histogram), np.cumsum(histogram * sizes)
    for e in range(1, capacity // 2 + 1):
        middle = int(mass[capacity - e] - mass[e - 1])
        best = max(best, int(count[-1] - count[capacity - e]) + -(-middle // capacity))
    for k in range(1, 21):
        exact = ((k + 1) * sizes) % capacity == 0
        # in units of capacity / k where not exact; scaled by k * capacity to stay whole
        value = np.where(exact, k * sizes, ((k + 1) * sizes) // capacity * capacity)
        best = max(best, -(-int((histogram * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each piece and the number of bins. Open bins stand in lists by free space, and a bit mask says which lists hold any."""
    order = np.argsort(-lengths, kind="stable")
    bins, free, mask, made = np.zeros(len(lengths), np.int64), [[] for _ in range(capacity + 1)], 0, 0
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[k] = b
        left = room - n
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, made


def pack_partitions(pieces: DataFrame, partitions: int, capacity: int, salt: int) -> DataFrame:
    """pieces (uid, length) with part, bin, used (of its bin), bins and bound (of its partition), spare (its emptier bins).

    Spare are the emptiest bin and those beyond which the fuller ones together leave more free than a share of half a
    bin among all partitions: what certified partitions close wastes half a bin in all.

    The partition is a hash of the piece's number, so that no document or length is hot.
    """
    keyed = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(partitions)).cast("int").alias("part"))
    schema = extended(keyed, ("bin", "long"), ("used", "long"), ("bins", "long"), ("bound", "long"), ("spare", "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["part"]):
            part = table.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                rows = table.slice(a, b - a)
                lengths = rows.column("length").to_numpy()
                bins, made = best_fit_decreasing(lengths, capacity)
                used = np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
                fullest = np.argsort(-used, kind="stable")
                spare = np.zeros(made, bool)
                spare[fullest] = np.cumsum(capacity - used[fullest]) > capacity // (2 * partitions)
                spare[fullest[-1]] = True
                bound = dual_feasible_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
                out = rows.append_column("bin", pa.array(bins)).append_column("used", pa.array(used[bins])).append_column("bins", pa.array(np.full(b - a, made))).append_column("bound", pa.array(np.full(b - a, bound))).append_column("spare", pa.array(spare[bins]))
                yield from out.combine_chunks().to_batches()

    return keyed.repartition(partitions, "part").sortWithinPartitions("part", "uid").mapInArrow(run, schema)


def first_partitions(pieces: int, most_pieces: int, least_pieces: int, parallelism: int) -> int:
    """Partitions of the first round: as many as run side by side, of `least_pieces` pieces or more, and of no more than `most_pieces`."""
    return max(1, -(-pieces // most_pieces), min(parallelism, pieces // least_pieces))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, most_pieces: int = 250_000, least_pieces: int = 40, most_rounds: int = 10, rounds: list | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every token of docs once, in few sequences of at most `capacity`.

    Only lengths are shuffled. The first round packs as many partitions as run side by side, of `most_pieces` pieces at
    most, so a task's memory is bounded by that. Final are bins that are full and, of partitions that meet their lower bound, all bins but the
    emptier ones, which hold what the bound rounds up. What is left is exchanged over half the partitions or fewer. Rows that repeat a doc_id, or have none, are
    documents of their own with places of their own. An empty table gives an empty result. Extra columns are ignored.
    `rounds`, if given, gets a dict a round: partitions, pieces, certified (partitions that met their bound), bins, bound.
    """
    ws = Workspace(docs.sparkSession, "packing")
    # each piece gets a number when it is written, by which its place finds it again
    pieces = ws.keep(tokenized_pieces(docs, vocabulary, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    open_pieces, final, partitions = pieces.select("uid", "length"), None, 1
    parallelism = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(most_rounds):
        n = open_pieces.count()
        if not n:
            break
        # half the partitions or fewer each round: what is left meets ever more of what other partitions left, in tasks
        # of 16 times the pieces at most
        partitions = max(1, min(-(-n // most_pieces), max(partitions // 2, -(-n // (16 * most_pieces)))), partitions // 4) if k else first_partitions(n, most_pieces, least_pieces, parallelism)
        packed = ws.keep(pack_partitions(open_pieces, partitions, capacity, k), f"packed-{k}")
        if rounds is not None:
            each = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
            told = each.agg(F.count("*"), F.sum((F.col("bins") <= F.col("bound")).cast("int")), F.sum("bins"), F.sum("bound")).first()
            rounds.append({"partitions": told[0], "pieces": n, "certified": told[1], "bins": told[2], "bound": told[3]})
        last = partitions == 1 or k + 1 == most_rounds
        done = F.lit(True) if last else ((F.col("bins") <= F.col("bound")) & ~F.col("spare")) | (F.col("used") == capacity)
        closed = packed.filter(done).select("uid", "length", (F.lit(k << 56) + F.col("part").cast("long") * (1 << 32) + F.col("bin")).alias("sequence_id"))
        final = closed if final is None else final.union(closed)
        if last:
            break
        open_pieces = packed.filter(~done).select("uid", "length")
    if final is None:
        return pieces.select("doc_id", *PIECE_COLUMNS, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = final.select("uid", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    return pieces.join(placed, "uid").select("doc_id", *PIECE_COLUMNS, "sequence_id", "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))

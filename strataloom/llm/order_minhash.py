"""Near-duplicate texts by Order MinHash and banded alignment.

The k-mers of a text are its shingles of five words, each labelled with its occurrence, so that they are unique in a
text. A sketch is the three k-mers of least hash in the order in which they stand in the text: two texts share it only
if they share these k-mers in the same order, which follows edit similarity more closely than shared sets do. Sketches
give candidates; a candidate pair is a link if a banded alignment of the two word sequences, of lengths n and m,
matches c words with c / (n + m - c) >= 0.8. Classes are the connected components of links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import code_points, mix64, run_starts, sorted_runs, text_slices
from .buckets import bucket_members
from .components import connected_components
from .workspace import Workspace

#: Two texts that differ in words spread evenly, so that a tenth of the words of each is unmatched, share 0.42 of their
#: k-mers, a sketch with probability 0.07, and one of 40 sketches with 0.95; at half of that difference, with 0.99999.
WORDS, SKETCHES, LEAST_KMERS, SIMILARITY = 5, 40, 3, 0.8
#: Documents, and words, of a bucket or candidate group that one task compares; larger groups are split in blocks and block pairs.
BLOCK, BLOCK_WORDS = 1024, 1 << 19
#: A pair that shares a sketch is aligned if 13 of 64 least k-mers agree. At similarity 0.8 with evenly spread
#: differences, the worst case, 25 do on average and fewer than 13 once in 1,000; texts that share a passage have fewer.
MINIMA, AGREE = 64, 13
#: Sequences above this are aligned piece by piece between unique k-mers that both have in one order.
LONG = 30_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def word_letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


@cache
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(97).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased alphanumeric words of all texts, and where each text's words begin (one bound more)."""
    points, bounds = code_points([t.lower() for t in texts])
    edge = np.diff(word_letters()[points].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    n = len(points)
    up, down = np.full(n, _P, np.uint64), np.full(n, np.uint64(pow(int(_P), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
    return mix64((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64)), np.searchsorted(begin, bounds)


def kmers(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of all texts in text order, and their bounds. A text of 1 to 4 words has one k-mer, its words."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(words) >= WORDS:
        s = words[: len(words) - WORDS + 1].copy()
        for k in range(1, WORDS):
            s = s * _P + words[k : len(words) - WORDS + 1 + k]
        whole = owner[: len(s)] == owner[WORDS - 1 :]
        s, s_owner = s[whole], owner[: len(whole)][whole]
    else:
        s, s_owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        made = []
        for d in short:
            h = np.uint64(1)
            for w in words[bounds[d] : bounds[d + 1]]:
                h = np.uint64((int(h) * int(_Q) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            made.append(h)
        place = np.searchsorted(s_owner, short)
        s, s_owner = np.insert(s, place, np.array(made, np.uint64)), np.insert(s_owner, place, short)
    # the occurrence of a k-mer in its text: its place in the run of equal (text, k-mer)
    key = s ^ (s_owner.astype(np.uint64) * _Q)
    order = np.argsort(key, kind="stable")
    run = np.ones(len(s), bool)
    run[1:] = key[order][1:] != key[order][:-1]
    at = np.arange(len(s))
    occurrence = np.empty(len(s), np.int64)
    occurrence[order] = at - np.maximum.accumulate(np.where(run, at, 0)) if len(s) else 0
    return mix64(s + occurrence.astype(np.uint64) * _Q), np.searchsorted(s_owner, np.arange(len(counts) + 1))


def least_kmers(labelled: np.ndarray, bounds: np.ndarray, multiplier: np.uint64, n: int) -> Iterator[np.ndarray]:
    """For each text with k-mers, the n least as (hash << 32 | place), one array after the other; all bits set where there are no more."""
    v = ((labelled * multiplier) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(labelled), dtype=np.uint64)
    starts = bounds[:-1][np.diff(bounds) > 0]
    for k in range(n):
        least = np.minimum.reduceat(v, starts)
        yield least
        if k + 1 < n:
            v[(least[least != _TOP] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = _TOP


def sketch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: fingerprint (two numbers), number of words, sketch keys, and 8 bits of each of MINIMA least k-mers."""
    words, bounds = word_hashes(texts)
    labelled, k_bounds = kmers(words, bounds)
    n = len(texts)
    some = np.flatnonzero(np.diff(k_bounds))
    prints = np.zeros((n, 2), np.int64)
    with_words = np.flatnonzero(np.diff(bounds))
    if len(with_words):
        place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
        for c, odd in enumerate((_P, _Q)):
            powers = np.full(int(place.max()) + 1, odd, np.uint64)
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            prints[with_words, c] = np.add.reduceat(words * powers[place], bounds[:-1][with_words]).view(np.int64)
    for d in np.flatnonzero(np.diff(bounds) == 0):  # no word: equal only to the same text
        prints[d] = np.frombuffer(hashlib.blake2b(texts[d].encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64)
    keys, minima = np.zeros((n, SKETCHES), np.int64), np.zeros((n, MINIMA), np.uint8)
    if len(some):
        for t, multiplier in enumerate(multipliers(MINIMA)):
            found = np.stack(list(least_kmers(labelled, k_bounds, multiplier, LEAST_KMERS if t < SKETCHES else 1)), axis=1)
            minima[some, t] = (found[:, 0] >> np.uint64(40)).astype(np.uint8)
            if t >= SKETCHES:
                continue
            places = np.sort(np.where(found == _TOP, _TOP, found & np.uint64(0xFFFFFFFF)), axis=1)  # back in text order
            key = np.full(len(some), np.uint64((t + 1) * int(_Q) & 0xFFFFFFFFFFFFFFFF))
            for k in range(LEAST_KMERS):
                there = places[:, k] != _TOP
                kmer = np.zeros(len(some), np.uint64)
                kmer[there] = labelled[places[there, k].astype(np.int64)]
                key = mix64(key * _P + kmer)
            keys[some, t] = key.view(np.int64)
    return prints, np.diff(bounds), keys, minima


def numbered(ws: Workspace, docs: DataFrame) -> DataFrame:
    """docs with row_uid, written once: both readings of the texts, and whoever joins rows again, see the same numbers."""
    return ws.keep(docs.withColumn("row_uid", F.monotonically_increasing_id()), "numbered")


def sketched(docs: DataFrame) -> DataFrame:
    """row_uid, doc_id, f1, f2 (fingerprint of the words), n_words, keys and minima (packed) for every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                prints, count, keys, minima = sketch(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(texts)) for c in ("row_uid", "doc_id")), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array(count), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (keys, minima))],
                    names=["row_uid", "doc_id", "f1", "f2", "n_words", "keys", "minima"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row_uid", "doc_id", "text").mapInArrow(run, f"row_uid long, doc_id {kind}, f1 long, f2 long, n_words long, keys binary, minima binary")


class Forest:
    """Union-find over the rows of one group."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.root[max(x, y)] = min(x, y)
        return True


def in_blocks(members: DataFrame, group: list[str], doc_id: str) -> DataFrame:
    """members (with n_words) of groups of two and more, once for every pair of blocks (lo, hi) of their group that they are compared in."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    sizes = members.groupBy(*group).agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).filter("n > 1").select(*group, blocks.alias("blocks"))
    placed = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64(doc_id), F.col("blocks")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")


def agreeing(minima: np.ndarray, i: int) -> np.ndarray:
    """Of the rows after i, how many least k-mers each shares with it."""
    return (minima[i + 1 :] == minima[i]).sum(axis=1)


def candidate_links(representatives: DataFrame) -> DataFrame:
    """a, b: for each bucket of a sketch, links that span its texts. Keys alone are shuffled first; the minima follow where a bucket holds two."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("row_uid").to_numpy(), SKETCHES)), pa.array(keys)], names=["uid", "key"])

    rows = representatives.filter(F.col("n_words") >= WORDS)
    tasks = bucket_members(rows.select("row_uid", "keys").mapInArrow(keyed, "uid long, key long"), BLOCK)
    order = ["key", "lo", "hi"]
    full = tasks.join(rows.select(F.col("row_uid").alias("uid"), "minima"), "uid").select("uid", "minima", *order, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, order):
            starts = np.append(run_starts(table, order), table.num_rows)
            ids, minima = table.column("uid").to_numpy(), np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint8).reshape(-1, MINIMA)
            a, b = [], []
            for k in np.flatnonzero(np.diff(starts) > 1):
                first, stop = int(starts[k]), int(starts[k + 1])
                forest, own = Forest(stop - first), minima[first:stop]
                for i in range(len(own) - 1):
                    for j in np.flatnonzero(agreeing(own, i) >= AGREE).tolist():
                        if forest.join(i, i + 1 + j):
                            a.append(ids[first + i])
                            b.append(ids[first + i + 1 + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return full.repartition(*order).sortWithinPartitions(*order, "uid").mapInArrow(run, "a long, b long")


def banded_matches(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence of two sequences whose partners stand at most `band` places apart; 64 places at a time."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    window, v = (1 << 2 * band + 1) - 1, full
    for j, w in enumerate(b):
        m = places.get(w)
        if m:
            u = v & m & (window << j - band if j > band else window >> band - j)
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def anchors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of k-mers that are unique in both sequences, in one rising order, LONG // 4 apart or more."""
    def unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x[: len(x) - WORDS + 1].copy()
        for k in range(1, WORDS):
            h = h * _P + x[k : len(x) - WORDS + 1 + k]
        values, first, count = np.unique(h, return_index=True, return_counts=True)
        return values[count == 1], first[count == 1]

    (x, at_x), (y, at_y) = unique(a), unique(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(at_x[i])
    found, last = [], (0, 0)
    for p, q in zip(at_x[i][order].tolist(), at_y[j][order].tolist()):
        # partners so far from the same place as the last ones would break the band
        if p - last[0] >= LONG // 4 and abs((p - last[0]) - (q - last[1])) < LONG // 16:
            found.append((p, q))
            last = (p, q)
    return found


def word_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """c / (n + m - c) for the c words that a banded alignment of two word sequences matches, or 0 where that is below `least`.

    No alignment of that similarity leaves the band. What both begin and end with is matched at once. Sequences
    above LONG are cut at shared unique k-mers and aligned between them, so c may fall short there.
    """
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return 0.0
    needed = least * (n + m) / (1 + least)
    k = min(n, m)
    same = a[:k] == b[:k]
    head = k if same.all() else int(same.argmin())
    k -= head
    same = a[n - k :][::-1] == b[m - k :][::-1]
    tail = k if same.all() else int(same.argmin())
    c, band = head + tail, int((n + m) * (1 - least) / (1 + least)) + 1
    a, b = a[head : n - tail], b[head : m - tail]
    if len(a) and len(b):
        # as many matches as the two bags of words allow
        (x, x_count), (y, y_count) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if c + np.minimum(x_count[i], y_count[j]).sum() < needed - 1e-9:
            return 0.0
        cuts = [(0, 0), *(anchors(a, b) if max(len(a), len(b)) > LONG else []), (len(a), len(b))]
        for (p, q), (r, s) in zip(cuts, cuts[1:]):
            c += banded_matches(a[p:r].tolist(), b[q:s].tolist(), band)
    return c / (n + m - c) if c >= needed - 1e-9 else 0.0


def verified_links(texts: list[str], minima: np.ndarray, side: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links that span the texts' classes. Every pair whose least k-mers agree enough is aligned, unless links found already put both in one class; with `side`, pairs of one row on each side."""
    words, bounds = word_hashes(texts)
    lengths = np.diff(bounds)
    forest, links = Forest(len(texts)), []
    for i in range(len(texts) - 1):
        agree = agreeing(minima, i)
        fits = (agree >= AGREE) & (np.minimum(lengths[i + 1 :], lengths[i]) >= least * np.maximum(lengths[i + 1 :], lengths[i]))
        if side is not None:
            fits &= side[i + 1 :] != side[i]
        near = np.flatnonzero(fits)
        for j in near[np.argsort(-agree[near], kind="stable")].tolist():
            j += i + 1
            if forest.find(i) != forest.find(j) and word_similarity(words[bounds[i] : bounds[i + 1]], words[bounds[j] : bounds[j + 1]], least):
                forest.join(i, j)
                links.append((i, j))
    return links


def row_classes(ws: Workspace, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """row_uid, doc_id, class_row, class_id, representative, kept: one row for each row of docs, which come from `numbered`.

    class_row is the row that a class keeps: of its rows the one of the least doc_id, null last, then of the least
    row_uid; kept holds for it alone. class_id is its doc_id. representative is the least doc_id with the same words (so
    copies meet without pairs). Rows are told apart by row_uid only, so a doc_id may repeat or be null. Words are
    lower-cased runs of letters and digits; texts of the same words are in one class whatever stands between. Texts of
    fewer than five words, and texts without a word (null counts as empty), are alike only if equal in words, or in text.

    The texts are read twice: once for sketches, of which 0.4 KB a row are kept, and once for those that are
    candidates. Copies are set aside first. Buckets and groups of any size are compared in blocks of BLOCK rows and
    BLOCK_WORDS words; a longer text is alone in a block.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_uid")
    rows = ws.keep(sketched(docs), "sketched")
    prints = rows.select("row_uid", "doc_id", "f1", "f2")
    first = prints.groupBy("f1", "f2").agg(F.min(rank).alias("first"))
    members = ws.keep(prints.join(first, ["f1", "f2"]).select("row_uid", "doc_id", F.col("first.row_uid").alias("first_row"), F.col("first.doc_id").alias("representative")), "members")
    alone = members.filter("row_uid = first_row")
    representatives = rows.join(alone.select("row_uid"), "row_uid", "left_semi")
    groups = connected_components(ws, candidate_links(representatives), "a", "b", "candidates")
    found = groups.select(F.col("id").alias("row_uid"), F.col("component").alias("group")).join(representatives.select("row_uid", "n_words", "minima"), "row_uid")
    candidates = ws.keep(in_blocks(found, ["group"], "row_uid"), "groups")
    order = ["group", "lo", "hi"]
    texts = docs.select("row_uid", "text").join(candidates, "row_uid").select("row_uid", "text", "minima", *order, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, order):
            starts = np.append(run_starts(table, order), table.num_rows)
            ids, block = table.column("row_uid").to_numpy(), table.column("block").to_numpy()
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            found = []
            for a, b in zip(starts.tolist(), starts[1:].tolist()):
                if b - a > 1:
                    side = block[a:b] if lo[a] != hi[a] else None
                    minima = np.frombuffer(b"".join(table.column("minima").slice(a, b - a).to_pylist()), np.uint8).reshape(-1, MINIMA)
                    found += [(ids[a + i], ids[a + j]) for i, j in verified_links([t or "" for t in table.column("text").slice(a, b - a).to_pylist()], minima, side, least)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    links = texts.repartition(*order).sortWithinPartitions(*order, "row_uid").mapInArrow(run, "a long, b long")
    linked = alone.join(connected_components(ws, links, "a", "b", "classes").withColumnRenamed("id", "row_uid"), "row_uid").select("component", rank.alias("rank"))
    best = linked.groupBy("component").agg(F.min("rank").alias("best"))
    moved = linked.join(best, "component").select(F.col("rank.row_uid").alias("first_row"), F.col("best.row_uid").alias("best_row"), F.col("best.doc_id").alias("best_id"))
    class_row = F.coalesce("best_row", "first_row")
    class_id = F.when(F.col("best_row").isNull(), F.col("representative")).otherwise(F.col("best_id"))
    out = members.join(moved, "first_row", "left")
    return out.select("row_uid", "doc_id", class_row.alias("class_row"), class_id.alias("class_id"), "representative", (class_row == F.col("row_uid")).alias("kept"))


def near_duplicate_rows(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """row_classes of docs (doc_id, text) in any order, for callers that need no other column of the rows."""
    ws = Workspace(docs.sparkSession, "order-minhash")
    out = row_classes(ws, numbered(ws, docs.select("doc_id", "text")), least)
    ws.drop("numbered", "sketched", "groups")  # what is left of the plan reads members and classes
    return out


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, representative, kept: the rows of near_duplicate_rows by doc_id, for docs whose ids are unique.

    Of a doc_id that repeats it tells the least class_id and representative, and whether any row is kept; rows without
    a doc_id are left out. To choose among rows, use near_duplicate_rows.
    """
    rows = near_duplicate_rows(docs, least).filter("doc_id is not null")
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("representative").alias("representative"), F.max("kept").alias("kept"))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all rows of documents."""
    return near_duplicate_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))

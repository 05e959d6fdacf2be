"""Near-duplicates of vectors and texts, and exact top-k, against brute force."""

import random
import re

import numpy as np
import pytest

from strataloom.llm.components import connected_components
from strataloom.llm.embedding_dedup import near_duplicates, plan_tables
from strataloom.llm.order_minhash import in_blocks, near_duplicate_classes, word_hashes, word_similarity
from strataloom.llm.segment_topk import top_k_exact
from strataloom.llm.workspace import Workspace

from .conftest import EDGES

VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(300, 420)] + [(500, k) for k in range(501, 560)]
    expected = roots(600, links)
    got = {r.id: r.component for r in connected_components(Workspace(spark, "t"), spark.createDataFrame([*links, (None, 3), (4, 4)], "x long, y long"), "x", "y").collect()}
    touched = {v for a, b in links if a != b for v in (a, b)}
    assert got == {v: expected[v] for v in touched}
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def clustered(n=300, width=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, width))
    x = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, width)) * rng.choice([0.02, 0.1, 0.18], (n, 1))
    x[7] = x[3]
    return x.astype(np.float32), rng.integers(0, 3, n)


def test_embedding_dedup(spark):
    x, labels = clustered()
    rows = [(i, v.tolist(), int(c), "clash") for i, (v, c) in enumerate(zip(x, labels))]
    odd = [(900, None, 0, ""), (901, [0.0] * 16, 0, ""), (902, [float("nan")] * 16, 0, ""), (903, [None] * 16, 0, ""), (904, x[3].tolist(), None, ""), (905, [], 1, ""), (906, [1.0], 1, "")]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows + odd, VECTORS)).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(close, False)
    root = roots(len(x), [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    assert close.sum() > 200
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (close[i].sum(), root[i], root[i] == i)
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(x) + len(odd)
    assert near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_dedup_in_blocks(spark, monkeypatch):
    from strataloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal(8) + rng.standard_normal((120, 8)) * 0.1).astype(np.float32)
    got = near_duplicates(spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], VECTORS)).orderBy("vec_id").collect()
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    np.fill_diagonal(close, False)
    assert [r.n_links for r in got] == close.sum(1).tolist()


def test_copies_labels_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v, w = rng.standard_normal(8), rng.standard_normal(8)
    near = v + 0.05 * rng.standard_normal(8)
    # labels of any type are compared as they are; copies are counted without being compared
    rows = [(i, v.tolist(), 1.2) for i in range(10, 60)] + [(1, near.tolist(), 1.2), (2, v.tolist(), 1.7), (3, (2 * v).tolist(), 1.2)] + [(70, w.tolist(), 1.2), (70, v.tolist(), 1.2), (70, w.tolist(), 1.7)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect())
    assert got[0] == (1, 52, 1, True) and got[1] == (2, 0, 2, True) and got[2] == (3, 52, 1, False)
    assert all((n, c, k) == (52, 1, False) for i, n, c, k in got if 10 <= i < 60)
    assert [g[1:] for g in got if g[0] == 70] == [(0, 1, False), (0, 1, False), (52, 1, False)]


def test_bucket_of_wide_vectors_stays_small():
    import tracemalloc

    from strataloom.llm.embedding_dedup import bucket_links

    rng = np.random.default_rng(3)
    x = rng.standard_normal(768) + rng.standard_normal((1024, 768)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    links, root = bucket_links(x, np.zeros((1024, 4), np.uint32), np.ones(1024, np.int64), 0, None, 0.98)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and (links == 1023).all() and (root == 0).all()
    tracemalloc.stop()


def test_exact_topk(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[20] = x[40] = x[60]
    odd = [(1000, None), (1100, [float("inf")] * 16), (1200, [None] * 16), (1300, []), (1400, [1.0] * 4), (1500, [2.0] * 4)]
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(i, v, "x") for i, v in odd], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in top_k_exact(rows, rows.filter("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    for q in range(0, 400, 20):
        score = whole @ whole[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(best)]
    assert got[1400] == [(1, 1500, 4 * 1024 * 2048)] and set(got) == {*range(0, 400, 20), 1400, 1500}
    none = rows.filter("false")
    assert top_k_exact(none, none, 5).count() == 0
    # whole numbers beyond doubles, ties among repeated ids, and what overflows when scaled
    big = spark.createDataFrame([(100, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0]), (3, [1.7e308, 1.0]), (2, [2.0**40, 2.0])], "vec_id long, embedding array<double>")
    found = [(r["rank"], r.vec_id, r.score) for r in top_k_exact(big, big.filter("vec_id = 100"), 5, scale=2.0).orderBy("rank", "vec_id").collect()]
    assert [f[1:] for f in found] == [(1, 2**63 - 1), (2, 2**63 - 1), (2, 2**63 - 1)]


def test_bounds_prune_and_hold():
    from strataloom.llm.segment_topk import TopK, levels, statistics

    rng = np.random.default_rng(1)
    spread = np.floor(rng.standard_normal((3000, 64)) * 128)
    centres = rng.standard_normal((60, 64)) * 128
    clustered = np.floor(centres[rng.integers(0, 60, 3000)] + rng.standard_normal((3000, 64)) * 16)
    for x, least in ((spread, 0.7), (clustered, 0.95)):
        for n in levels(64):
            assert (statistics(x[:50], n) @ statistics(x, n).T + 1e-6 >= x[:50] @ x.T).all()
        top = TopK(np.arange(0, 3000, 60), x[::60], 10)
        for a in range(0, 3000, 500):
            top.add(np.arange(a, a + 500), x[a : a + 500])
        assert top.pairs == 50 * 2999 and top.exact < (1 - least) * top.pairs
        for q, best in zip(top.ids.tolist(), top.best):
            score = x @ x[q]
            assert best == sorted((-int(score[i]), i) for i in range(3000) if i != q)[:10]
    assert levels(3) == [1, 2] and levels(1) == [1]


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingle_share(x, y):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x, y))
    return len(x & y) / max(1, len(x | y))


def aligned(x, y):
    """Longest common subsequence by the plain table, over all words of both but the matched ones."""
    row = [0] * (len(y) + 1)
    for w in x:
        before = 0
        for j, v in enumerate(y, 1):
            before, row[j] = row[j], before + 1 if w == v else max(row[j], row[j - 1])
    return row[-1] / max(1, len(x) + len(y) - row[-1])


def edited(text, share, rng):
    return " ".join(w + "x" if rng.random() < share else w for w in text.split())


def corpus(sentence):
    rng, texts = random.Random(8), []
    for k in range(40):
        base = sentence("en", rng.randint(20, 300), k)
        texts += [base] + [edited(base, share, rng) for share in (0.004, 0.01, 0.03)] + [base.upper()] * (k % 3)
    shared = sentence("de", 60, 1)
    texts += [sentence("fr", 150, k) + " " + shared + " " + sentence("fr", 150, k + 500) for k in range(30)]
    return texts + ["same few words", "Same, few words!", "other few words", *EDGES, ""]


def brute(texts, share=0.3):
    """Classes by plain Python: words by a regular expression, shared shingles by sets, alignment by the plain table."""
    words, links = [words_of(t) for t in texts], []
    bags = [set(w) for w in words]
    for a in range(len(texts)):
        for b in range(a):
            x, y = words[a], words[b]
            if x == y and (x or (texts[a] or "") == (texts[b] or "")):
                links.append((b, a))
            elif min(len(x), len(y)) >= max(5, 0.8 * max(len(x), len(y))) and len(bags[a] & bags[b]) >= 0.5 * len(bags[a]) and shingle_share(x, y) >= share and aligned(x, y) >= 0.8:
                links.append((b, a))
    return roots(len(texts), links)


def test_text_duplicates(spark, sentence):
    texts = corpus(sentence)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "twice"), (None, "no id", "")], "doc_id long, text string, class_id string")
    got = {r.doc_id: r for r in near_duplicate_classes(docs).collect()}
    expected = brute(texts)
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(expected))
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    assert near_duplicate_classes(docs.filter("false")).count() == 0


def test_text_duplicates_in_blocks(spark, sentence, monkeypatch):
    from strataloom.llm import order_minhash

    monkeypatch.setattr(order_minhash, "BLOCK", 8)
    rng = random.Random(3)
    base = sentence("en", 200, 77)
    texts = [edited(base, 0.006, rng) for _ in range(50)]
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_near_copies_are_caught(spark, sentence):
    """Recall on edited copies: three in a hundred words changed, and up to nine, by replacing, dropping and adding."""
    rng, texts, pairs = random.Random(12), [], []
    for k in range(150):
        base = sentence("en", rng.choice([60, 120, 200, 400]), 1000 + k).split()
        share, copy = (0.03 if k < 100 else 0.09), []
        for w in base:
            if rng.random() < share:
                copy += rng.choice([[], [w, w + "y"], [w + "x"]])
            else:
                copy.append(w)
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(copy)]
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    light = [got[a] == got[b] for a, b in pairs[:100]]
    heavy = [got[a] == got[b] for a, b in pairs[100:] if aligned(words_of(texts[a]), words_of(texts[b])) >= 0.8]
    assert all(light) and np.mean(heavy) >= 0.9
    assert all(got[a] in pairs[k] for k, p in enumerate(pairs) for a in p)  # nothing else is joined


def test_alignment_against_the_plain_table():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.randrange(40) for _ in range(rng.randint(5, 60))]
        y = [w for w in x if rng.random() > 0.08]
        y.insert(rng.randint(0, len(y)), 99)
        got, wanted = word_similarity(np.array(x, np.uint64), np.array(y, np.uint64), 0.8), aligned(x, y)
        assert got == (pytest.approx(wanted) if wanted >= 0.8 else 0)


def test_long_texts_are_aligned_between_anchors():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 60, 70_000).astype(np.uint64)
    y = np.delete(x, rng.integers(1, 69_999, 3000))
    y[::50] = 7
    assert word_similarity(x, y, 0.8) > 0.9 and word_similarity(x, y[::-1].copy(), 0.8) == 0


def test_blocks_meet_once(spark):
    members = spark.range(5000).selectExpr("id AS doc_id", "0 AS g", "1L AS n_words").union(spark.range(9, 10).selectExpr("id", "1", "1L"))
    rows = in_blocks(members, ["g"], "doc_id")
    pairs = {(r.lo, r.hi) for r in rows.select("lo", "hi").distinct().collect()}
    assert pairs == {(a, b) for a in range(5) for b in range(a, 5)} and rows.filter("g = 1").count() == 0


def test_order_matters():
    from strataloom.llm.order_minhash import sketch

    there, turned = " ".join(f"w{k}" for k in range(100)), " ".join(f"w{(k + 50) % 100}" for k in range(100))
    words, bounds = word_hashes([there, turned])
    assert word_similarity(words[:100], words[100:], 0.8) == 0 and word_similarity(words[:100], words[:100], 0.8) == 1
    _, _, keys, minima = sketch([there, turned])
    # the two sets of k-mers are nearly equal, the orders are not
    assert (minima[0] == minima[1]).mean() > 0.7 and (keys[0] == keys[1]).mean() < 0.5


def test_tables_follow_the_rows():
    assert plan_tables(500, 0.98) == plan_tables(2048, 0.98) == (22, 16)
    tables, signs = plan_tables(10**8, 0.98)
    assert signs == 32 and (1 - (1 - np.arccos(0.98) / np.pi) ** signs) ** tables <= 1e-4
    assert plan_tables(1 << 60, 0.98)[1] == 48
    assert plan_tables(0, 1.0) == (1, 16)


def test_rows_are_told_apart_without_ids(spark, sentence):
    import corpus_pipeline
    from strataloom.llm.order_minhash import near_duplicate_rows

    a, b, c, d = (sentence("en", 80, k) for k in range(4))
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, c + "!"), (None, a), (7, d), (7, d), (None, d), (0, "few words"), (0, sentence("fr", 60, 9)), (0, sentence("fr", 60, 10))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").coalesce(1)
    got = [(r.doc_id, r.class_id, r.kept) for r in near_duplicate_rows(docs).orderBy("row_uid").collect()]
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (None, None, True), (None, None, False), (None, 3, False), (7, 7, True), (7, 7, False), (None, 7, False), (0, 0, True), (0, 0, True), (0, 0, True)]
    classes = near_duplicate_rows(docs).groupBy("class_row").count().collect()
    assert sorted(r["count"] for r in classes) == [1, 1, 1, 2, 2, 3, 3]
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect()) == sorted([(False, 3, a), (False, 5, b), (True, 0, c), (False, 7, d), *((False, i, t) for i, t in rows if i == 0)])

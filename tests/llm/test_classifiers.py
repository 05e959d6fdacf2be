"""Learned operators: accuracy on rows that were held out, and the edges."""

import zlib

import numpy as np
import pytest

from strataloom.llm.language_filter import LanguageFilters, detect_languages
from strataloom.llm.subword_quality import SubwordClassifier, features, score_quality
from strataloom.llm.toxicity import NaiveBayesLinear, score_toxicity

from .conftest import EDGES


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def rows(sentence):
    made = []
    for i in range(240):
        text = sentence("en", 60, i)
        quality, toxic = int(i % 3 != 0), int(i % 4 == 0)
        if not quality:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else (text.split()[0] + " ") * 80
        if toxic:
            text += " vilescum" + "er" * (i % 3) + " you " + sentence("en", 5, i + 999)
        made.append((i, text, quality, toxic))
    return made


def tables(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], "clash") for r in rows] + [(10_000 + k, t, "e") for k, t in enumerate(EDGES)] + [(5, rows[5][1], "twice")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(77_777, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity(spark, rows):
    docs, labels = tables(spark, rows)
    got = score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(EDGES) + 1 and all(0 <= r.toxicity <= 1 for r in got)
    score = {r.doc_id: r.toxicity for r in got}
    held = [r for r in rows if out(r[0])]
    assert np.mean([(score[r[0]] >= 0.5) == bool(r[3]) for r in held]) > 0.95
    assert score_toxicity(docs.filter("false"), labels).count() == 0
    assert {r.toxicity for r in score_toxicity(docs, labels.filter("false")).collect()} == {0.5}


def test_quality(spark, rows):
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r.quality_score for r in score_quality(docs, labels).collect()}
    held = [r for r in rows if out(r[0])]
    assert np.mean([(got[r[0]] >= 0.3) == bool(r[2]) for r in held]) > 0.95 and all(0 <= s <= 1 for s in got.values())
    assert score_quality(docs, labels.filter("false")).select("quality_score").distinct().count() == 1


def test_labels_that_are_held_out_are_not_learned(spark, rows):
    docs, labels = tables(spark, rows)
    from pyspark.sql import functions as F

    from strataloom.llm.labelled import held_out

    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r.doc_id, r.toxicity) for r in df.collect())
    assert key(score_toxicity(docs, labels)) == key(score_toxicity(docs, turned))


def test_features_do_not_depend_on_the_batch():
    texts = ["one two two", "", "three", "x" * 300]
    together = features(texts, (3, 4), 1 << 16)
    for k, t in enumerate(texts):
        alone = np.sort(features([t], (3, 4), 1 << 16)[0])
        assert (np.sort(together[0][together[1] == k]) == alone).all()
    model = SubwordClassifier.fit(["a b"], [1])
    assert model.score(["", "a"])[0] == model.score([""])[0]
    nb = NaiveBayesLinear.fit([], [])
    assert nb.score(["", "x"]).tolist() == [0.5, 0.5]


def test_languages(spark, sentence):
    data = [(i, sentence(lang, 30, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame([(*r, "clash") for r in data] + [(5_000 + k, t, None, "e") for k, t in enumerate(EDGES)] + [(9_999, "123 ... !!", "en", "")], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in detect_languages(docs).collect()}
    held = [r for r in data if out(r[0])]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    for k, t in enumerate(EDGES):
        r = got[5_000 + k]
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, t or ""))) and 0 <= r.score <= 1
    assert (got[9_999].lang_pred, got[9_999].score) == ("und", 0.0)
    assert detect_languages(docs.filter("false")).count() == 0
    assert {r.lang_pred for r in detect_languages(docs.withColumn("lang", docs.lang.substr(1, 0)).filter("lang is null")).collect()} == {"und"}


def test_many_languages_use_more_words_of_bits():
    texts = [f"tag{k:03d}word " * 20 for k in range(70)]
    model = LanguageFilters.fit(texts, [f"l{k:03d}" for k in range(70)])
    assert len(model.words) == 2
    assert model.predict(texts)[0] == [f"l{k:03d}" for k in range(70)]
    assert LanguageFilters.fit([], []).predict(["x"]) == (["und"], pytest.approx([0.0]), pytest.approx([0]))


def grams(text, n):
    """Of a lower-cased text between two blanks."""
    padded = f" {text.lower()} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def test_languages_against_sets_of_grams(sentence):
    """Filters return every language that holds a gram, and counts that differ from exact sets by chance only."""
    data = [(sentence(lang, 30, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    model = LanguageFilters.fit(*zip(*data))
    exact = {}
    for lang in model.languages:
        own = [set(grams(t, 4)) for t, x in data if x == lang]
        exact[lang] = {g for g in set().union(*own) if sum(g in o for o in own) >= max(2, 0.02 * len(own))}
    texts = [sentence(lang, 12, i + 500) for i, lang in enumerate(["en", "de", "fr"] * 10)] + ["", "x", "the ing", "été 🙂"]
    total, counts = model.hits(texts)
    for k, t in enumerate(texts):
        plain = [sum(g in exact[lang] for g in grams(t, 4)) for lang in model.languages]
        assert total[k] == max(len(t) - 1, 0) and np.abs(counts[:, k] - plain).max() <= 1
        if max(plain) > 20:
            assert model.predict([t])[0] == [model.languages[int(np.argmax(plain))]]


def test_short_texts_use_shorter_grams(sentence):
    data = [(sentence(lang, 30, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    model = LanguageFilters.fit(*zip(*data))
    langs, scores, _ = model.predict(["sch", "eau", "!!", ""])
    assert langs == ["de", "fr", "und", "und"] and (scores[:2] > 0.5).all() and scores[2:].tolist() == [0, 0]


def mixed(h, salt):
    h ^= salt
    h ^= h >> 16
    h = h * 0x85EBCA6B & 0xFFFFFFFF
    h ^= h >> 13
    h = h * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def test_toxicity_against_plain_python(rows):
    """Scores by plain Python sets of n-grams and one dictionary of weights."""
    model = NaiveBayesLinear.fit([r[1] for r in rows[:120]], [r[3] for r in rows[:120]])

    def slot(gram):
        h = 0
        for k, c in enumerate(gram):
            h = ((h * 0x01000193 if k else 0) + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
        return mixed(h, len(gram) * 0x2545F491 & 0xFFFFFFFF) & (model.buckets - 1)

    for text in [r[1] for r in rows[120:150]] + ["", "a", "ab", "you " * 50]:
        found = {slot(g) for n in (3, 4, 5) for g in grams(text, n)}
        z = model.bias + sum(float(model.weight[s]) for s in found)
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    # log-count ratios: a gram of toxic rows only is among the features, with a weight that speaks for label 1
    assert model.weight[slot("vile")] > 0 and np.count_nonzero(model.weight) > 10


def test_quality_features_against_plain_python(sentence):
    """Equal features fall together and different ones apart: counts of strings are counts of buckets."""
    from collections import Counter

    texts = [sentence("en", 40, 1) + " again again again", "", "a", "ab abc", "Été été  été\nx", "one one two"]
    for text in texts:
        words = text.split()
        plain = Counter(("w", w) for w in words)
        plain.update(("twice",) if a == b else ("p", a, b) for a, b in zip(words, words[1:]))
        padded = f" {text} "
        for n in (3, 4):
            plain.update((n, g) for g in (padded[k : k + n] for k in range(len(padded) - n + 1)) if not any(c.isspace() for c in g[1:-1]))
        got = Counter(features([text], (3, 4), 1 << 31)[0].tolist())
        assert sorted(got.values()) == sorted(plain.values())
    model = SubwordClassifier.fit(texts * 3, [1, 0, 1, 1, 1, 0] * 3, buckets=1 << 12)
    for text in texts:
        slots = features([text], (3, 4), 1 << 12)[0].tolist()
        z = sum(float(model.folded[s]) for s in slots) / max(len(slots), 1) + model.bias
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_ties_repeats_and_empty_tables(spark, rows):
    docs, labels = tables(spark, rows)
    twice = docs.union(docs)
    for score, name in ((score_toxicity, "toxicity"), (score_quality, "quality_score")):
        got = {}
        for r in score(twice, labels).collect():
            got.setdefault(r.text, set()).add(r[name])
        assert all(len(s) == 1 for s in got.values())  # equal texts have one score, null and empty ones too
        assert got[None] == got[""]
        assert score(docs.filter("false"), labels).count() == 0

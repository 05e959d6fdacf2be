"""The pipeline against its stages' brute-force versions, and the queries that have SQL."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strataloom.llm import queries
from strataloom.llm.labelled import labelled_sample, language_sample
from strataloom.llm.language_filter import LanguageFilters
from strataloom.llm.packing import cut, dual_feasible_bound
from strataloom.llm.subword_quality import SubwordClassifier

from .test_duplicates import brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op5_exact_topk"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    got = queries.QUERIES[name](spark, str(DATA))
    expected = sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_pipeline_equals_its_stages_one_by_one(spark, vocabulary):
    from strataloom.llm.bpe_units import load_tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    quality = SubwordClassifier.fit(*labelled_sample(docs, labels, "quality", 2500))
    kept = [i for i in sorted(rows) if quality.score([rows[i].text or ""])[0] >= corpus_pipeline.LEAST_QUALITY]
    assert 0 < len(kept) < len(rows)
    good = docs.filter(docs.doc_id.isin(kept))
    model = LanguageFilters.fit(*language_sample(good, 1500))
    named = []
    for i in kept:
        lang, score, grams = model.predict([rows[i].text or ""])
        if any(map(str.isalpha, rows[i].text or "")) and (score[0] > corpus_pipeline.LEAST_LANGUAGE or grams[0] < corpus_pipeline.LEAST_GRAMS):
            named.append(i)
    classes = brute([rows[i].text for i in named])
    alone = [named[k] for k in range(len(named)) if classes[k] == k]
    tokenizer, wanted = load_tokenizer(vocabulary), []
    for i in alone:
        ids = np.array([*tokenizer.encode(rows[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        wanted += [(i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cut(len(ids), 2048))]
    out = corpus_pipeline.run(spark, str(DATA)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(wanted)
    used = {}
    for r in out:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    bound = dual_feasible_bound(np.bincount([r.length for r in out], minlength=2049), 2048)
    assert max(used.values()) <= 2048 and bound <= len(used) <= bound + 1


def test_stages_at_the_edges(spark, tmp_path, sentence):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables; without languages or labels nothing goes for lack of them."""
    from .conftest import EDGES

    data = [(i, sentence("en", 60, i), "en") for i in range(30)] + [(100 + k, t, None) for k, t in enumerate(EDGES)] + [(0, sentence("en", 60, 0), "en"), (None, "no id here at all", None)]
    names = ["score", "lang_pred", "quality_score", "lang_score", "row_uid", "class_row", "uid", "piece"]
    docs = spark.createDataFrame([(*r, *names) for r in data], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, at, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        kept = out.collect()
        assert kept and all([r[c] for c in names] == names for r in kept)
        at = out
    assert {r.doc_id for r in kept} >= {*range(30), None} and len(kept) == len({r.text for r in kept})
    letters = sum(any(map(str.isalpha, t or "")) for _, t, lang in data if lang is None)
    assert corpus_pipeline.language_stage(spark, docs.filter("lang is null"), str(tmp_path)).count() == letters
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_runs(spark):
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1
    assert queries.QUERIES["op7_sharding"](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()

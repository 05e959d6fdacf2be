"""Queries against their SQL on tables made to show what the driver's smallest tables do not."""

import datetime
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strataloom.operators import resolve, search
from strataloom.plans import catalogue


def answers(spark, folder, name, tables):
    """Rows of the query and of its SQL over tables, a dict of name to list of dicts."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), folder / f"{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = ", ".join(sorted(df.columns))
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr), sorted(con.sql(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]})").fetchall(), key=repr)


def part(key, name="red bolt", brand=1, kind="SMALL", size=1):
    return {"p_partkey": key, "p_name": name, "p_brand": f"Brand#{brand}", "p_type": kind, "p_size": size, "p_retailprice": 1.0}


def line(order, number, key):
    return {"l_orderkey": order, "l_partkey": key, "l_suppkey": 1, "l_linenumber": number, "l_quantity": 50.0, "l_extendedprice": 1.0, "l_returnflag": "N", "l_shipdate": datetime.datetime(2000, 1, 1)}


@pytest.mark.parametrize("name", ["symbol_context", "context_text", "context_mermaid"])
def test_hub_that_calls_nothing(spark, tmp_path, name):
    tables = {"part": [part(k, f"part {k}") for k in range(3)], "lineitem": [line(1, 1, 1), line(1, 2, 0), line(2, 1, 2), line(2, 2, 0)]}
    got, expected = answers(spark, tmp_path, name, tables)
    assert got == expected and len(got) == 1


def most_rows(df):
    """The most rows that a step of the plan gave while df was collected."""
    df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        rows = plan.metrics().get("numOutputRows")
        below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        return max([rows.get().value() if rows.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def common(spark):
    """Symbols of one name in three files of which the second imports the first and the third."""
    symbols = spark.range(3000).selectExpr("id", "'User' AS name", "id % 3 AS file_id", "id AS seq", "if(id % 2 = 0, 'class', 'function') AS kind")
    imports = spark.createDataFrame([(1, 2), (1, 0)], "file_id long, target long")
    return symbols, imports


def test_bases_of_a_common_name(spark, common):
    symbols, imports = common
    bases = symbols.selectExpr("id AS child_id", "file_id", "name AS base").union(spark.sql("SELECT -1L, 1L, 'User' UNION ALL SELECT -2L, 9L, 'User' UNION ALL SELECT -3L, CAST(NULL AS LONG), 'User'"))
    found = resolve.resolve_bases(bases, symbols, imports)
    got = dict(found.collect())
    # the last of the own file, for itself the one before; without an own file the first of all
    assert got == {i: (2997 + i % 3 if i < 2997 else i - 3) for i in range(3000)} | {-1: 2998, -2: 0, -3: 0}
    assert most_rows(found) < 10 * 3000


@pytest.mark.parametrize("name", ["inherits_join", "injects_join"])
def test_few_names_in_few_files(spark, tmp_path, name):
    rng = random.Random(5)
    parts = [part(k, rng.choice(["red bolt", "red nut", "old bolt"] if k < 300 else ["large rod"]), rng.randint(1, 30), rng.choice(["class", "SMALL"]), rng.randint(1, 4)) for k in range(400)]
    got, expected = answers(spark, tmp_path, name, {"part": parts + [part(500, "only one"), part(493, "lone"), part(499, "lonely")]})
    assert got == expected and len(got) > 300


def test_injections_of_a_common_name(spark, common):
    symbols, imports = common
    wanted = symbols.selectExpr("id AS class_id", "file_id", "name AS type_name", "'f' AS field_name").union(spark.sql("SELECT -1L, 1L, 'User', 'g' UNION ALL SELECT -2L, 9L, 'User', 'f'"))
    found = resolve.resolve_injections(wanted, symbols, imports)
    # the first class of the imported files, for who imports any; the name is not unique
    assert {tuple(r) for r in found.collect()} == {(i, 0, "f", "User") for i in range(1, 3000, 3)} | {(-1, 0, "g", "User")}
    assert most_rows(found) < 10 * 3000


def test_all_pairs_by_tiles(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (10_240, 4)).astype(np.float32)  # many equal directions, so ties at every rank, and zeros
    ids = rng.permutation(len(x)).astype(np.int64)
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": np.zeros(len(x), np.int32)}), tmp_path / "embeddings.parquet")
    rows = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    runs, plain = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: (runs.append(run), plain(self, run, schema))[1])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.batch_top_k(rows, rows.filter("vec_id % 10 = 0"), 5, "vec_id").collect()}
    unit = x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-9)
    score = np.round(unit[ids % 10 == 0] @ unit.T, 12)
    for q, s in zip(ids[ids % 10 == 0], score):
        s[ids == q] = -np.inf
        for rank, at in enumerate(np.lexsort((ids, -s))[:5], 1):
            assert got[q, rank] == (ids[at], pytest.approx(s[at], abs=1e-9))
    assert len(got) == 5 * len(score) and len(runs) == 1
    batch = pa.record_batch({"id": ids, "v": pa.array(x.tolist(), pa.list_(pa.float64()))})
    tracemalloc.start()
    list(runs[0](iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()

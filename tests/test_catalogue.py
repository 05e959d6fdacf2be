"""Every registered query of the core against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from strataloom.plans import catalogue, code_catalogue  # noqa: F401 - the second registers its queries with the first

DATA = Path("/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def canonical(rows):
    plain = [tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows]
    return sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert canonical(tuple(r) for r in df.select(*columns).collect()) == canonical(expected)


def test_exact_packing_beats_greedy_on_whole_quanta(spark):
    from strataloom.operators import knapsack

    items = spark.createDataFrame([(1, 9.0, 90), (2, 4.6, 45)], "id long, score double, cost long")
    assert [r.id for r in knapsack.pack(items, 90, "greedy").collect()] == [2]
    assert [r.id for r in knapsack.pack(items, 90, "dp", 15).collect()] == [1]
    assert [r.id for r in knapsack.pack(items, 90, "dp", 64).collect()] == [2]

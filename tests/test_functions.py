from pyspark.sql import functions as F

from strataloom.functions import text, vectors
from strataloom.operators import chunking, search, terms, traverse
from strataloom.operators.centrality import katz
from strataloom.operators.resolve import resolve_calls, resolve_imports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_split_identifier(spark):
    cases = {"getUserByEmail": "get user by email".split(), "MAX_RETRY_COUNT": "max retry count".split(), "parseHTTPResponse2Go": "parse http response2 go".split(), "user2Id": ["user2", "id"], "x": []}
    for name, words in cases.items():
        assert one(spark, text.split_identifier(F.lit(name))) == words
    assert one(spark, text.noun_tokens(F.array(F.lit("getUserByEmail")), True)) == ["user", "email"]
    assert one(spark, text.query_keywords(F.lit("How does JWT token verification work?"))) == ["how", "does", "jwt", "token", "verification", "work"]


def test_types_and_fences(spark):
    for note, name in {"Optional[UserRepo]": "UserRepo", "List[Foo]": "Foo", "Foo | None": "Foo", "int": None}.items():
        assert one(spark, text.unwrap_type(F.lit(note))) == name
    assert one(spark, text.unfenced(F.lit('```json\n[1]\n```'))) == "[1]"
    assert terms.parse_answer("```json\n[1, 2]\n```") == [1, 2] and terms.parse_answer("no") is None


def test_vectors(spark):
    lit = vectors.literal
    assert one(spark, vectors.norm(lit([3, 4]))) == 5
    assert one(spark, vectors.normalized(lit([0, 0]))) == [0, 0]
    assert one(spark, vectors.dot(lit([1, 0]), lit([0, 1]))) == 0
    assert one(spark, vectors.score(lit([1, 0]), lit([1, 0]))) == 1


def test_sliding_windows(spark):
    docs = spark.createDataFrame([("A" * 200,), ("   ",), (None,)], "text string")
    rows = chunking.sliding_windows(docs, 50, 10, "none").orderBy("start").collect()
    assert [r.start for r in rows] == [0, 40, 80, 120, 160]
    gap = spark.createDataFrame([("a" * 9 + "\n" + "b" * 30,)], "text string")
    parity = chunking.sliding_windows(gap, 20, 5, "end").orderBy("start").collect()
    assert (parity[0].end, parity[1].start) == (10, 15)
    closed = chunking.sliding_windows(gap, 20, 5, "advance").orderBy("start").collect()
    assert closed[0].end >= closed[1].start


def test_token_chunks(spark):
    lines = "".join("x" * 39 + "\n" for _ in range(5))
    rows = chunking.token_chunks(spark.createDataFrame([(lines,), (" \n",)], "text string"), 25, 3).orderBy("chunk_no").collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 2), (3, 4), (5, 5)]
    assert rows[1].chunk.startswith("x" * 11 + "\n")


def test_imports(spark):
    paths = ["pkg/__init__.py", "pkg/auth/jwt.py", "pkg/auth/utils.py", "pkg/models.py", "svc/auth/jwt.py", "web/src/a.ts", "web/src/util/index.ts", "src/auth/jwt.rs", "com/x/App.java"]
    files = spark.createDataFrame([(p, p) for p in paths], "file_id string, path string")
    cases = [
        ("pkg/auth/jwt.py", ".utils", "python", "pkg/auth/utils.py"), ("pkg/auth/jwt.py", "..models", "python", "pkg/models.py"), ("pkg/auth/jwt.py", "..", "python", "pkg/__init__.py"), ("pkg/auth/jwt.py", ".", "python", None),
        ("pkg/models.py", "pkg.auth.jwt", "python", "pkg/auth/jwt.py"), ("pkg/models.py", "pkg.auth.jwt.Token", "python", "pkg/auth/jwt.py"), ("x.py", "models", "python", "pkg/models.py"), ("x.py", "auth.jwt", "python", None), ("x.py", "numpy", "python", None),
        ("web/src/a.ts", "./util", "typescript", "web/src/util/index.ts"), ("web/src/a.ts", "react", "typescript", None),
        ("src/m.rs", "crate::auth::jwt", "rust", "src/auth/jwt.rs"), ("src/m.rs", "std::fmt", "rust", None), ("A.java", "com.x.App", "java", "com/x/App.java"), ("A.java", "x.App", "java", "com/x/App.java"), ("m.go", "x/y", "go", None),
    ]
    imports = spark.createDataFrame([(i, p, m, lang) for i, (p, m, lang, _) in enumerate(cases)], "import_id int, path string, module string, language string")
    found = {r.import_id: r.target for r in resolve_imports(imports, files).collect()}
    assert found == {i: c[3] for i, c in enumerate(cases)}


def test_call_tiers(spark):
    symbols = spark.createDataFrame([("a", "f1", "a", 0), ("b", "f1", "b", 1), ("g2", "f2", "g", 0), ("g3", "f3", "g", 0), ("h", "f3", "h", 1), ("k4", "f4", "k", 0), ("k5", "f5", "k", 0)], "id string, file_id string, name string, seq int")
    imports = spark.createDataFrame([("f1", "f2")], "file_id string, target string")
    calls = spark.createDataFrame([(1, "f1", "b", "a"), (2, "f1", "a", "g"), (3, "f1", "a", "h"), (4, "f1", "a", "k"), (5, "f1", "a", "a")], "call_id int, file_id string, caller_id string, callee string")
    got = {r.call_id: (r.tier, r.callee_id, r.confidence) for r in resolve_calls(calls, symbols, imports).collect()}
    assert got[1] == ("same_file", "a", 0.85) and got[2] == ("imported", "g2", 0.9) and got[3] == ("global", "h", 0.5)
    assert got[4][0] == "ambiguous_global" and got[5][0] == "self"


def test_impact_and_katz(spark):
    edges = spark.createDataFrame([("a", "t", 0.9), ("c", "t", 0.85), ("b", "a", 0.5), ("c", "b", 0.9), ("t", "c", 0.9)], "src string, tgt string, conf double")
    start = spark.createDataFrame([("t",)], "id string")
    assert {r.id: r.conf for r in traverse.widest_paths(edges, start).collect()} == {"a": 0.9, "c": 0.85, "b": 0.5}
    assert {r.id for r in traverse.widest_paths(edges, start, 0.85).collect()} == {"a", "c"}
    assert traverse.shortest_path(edges, "b", "c").first()["path"] == ["b", "a", "t", "c"]
    assert traverse.shortest_path(edges, "b", "zz").count() == 0
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    k = {r.id: (round(r.raw, 6), round(r.katz, 6)) for r in katz(nodes, spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "src string, tgt string")).collect()}
    assert k == {"a": (1.0, 0.0), "b": (1.0, 0.0), "c": (1.2, 1.0), "d": (1.12, 0.6)}


def test_rank_fusion(spark):
    lists = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(names)], "chunk_id string, rank int") for names in ("xyz", "pq")]
    assert [r.chunk_id for r in search.reciprocal_rank_fusion(lists).orderBy("rank").collect()] == ["x", "p", "y", "q", "z"]


def test_terms_and_concerns(spark):
    f = "struct<file_path:string,symbol_name:string,qualified_name:string,summary:string>"
    usages = spark.createDataFrame([(0, "r", "User Repo", "d", [], ("f", "s", "q", "u")), (1, "r2", "user repo", "d2", [], ("g", "s", "q", "v"))], f"seq int, raw_name string, expanded_name string, definition string, noun_tokens array<string>, functionality {f}")
    kb = terms.knowledge_base(usages)
    row = kb.first()
    assert row.expanded_name == "User Repo" and len(row.functionalities) == 2
    assert terms.search_terms(kb, ["user", "repo"]).first()["overlap"] == 2
    chunks = spark.createDataFrame([(0, "q0"), (1, "q1")], "place int, qualified_name string")
    built = terms.build_concerns(chunks, [{"name": "n", "indices": [0, 0, 99, "x"]}]).first()
    assert built.chunk_places == [0, 0] and built.symbols == ["q0"]
    three = spark.createDataFrame([(0,), (1,), (2,)], "concern int")
    assert [r.concern for r in terms.rank_concerns(three, [1, 5, 1]).orderBy("rank").collect()] == [1, 0, 2]


def test_hybrid_chunks(spark):
    chunks = spark.createDataFrame([("c1", "a.py", "f", [1.0, 0.0]), ("c2", "b.py", "g", [0.0, 1.0]), ("c3", "b.py", "h", [-1.0, 0.0])], "chunk_id string, path string, name string, embedding array<float>")
    symbols = spark.createDataFrame([("f", "f", "a.py", 1), ("g", "g", "b.py", 1), ("h", "h", "b.py", 5)], "id string, name string, file_path string, start_line int")
    edges = spark.createDataFrame([("CALLS", "h", "f"), ("CALLS", "g", "h")], "rel_type string, source_id string, target_id string")
    got = search.hybrid_chunks(chunks, symbols, edges, [1.0, 0.0], 1).collect()
    assert [(r.chunk_id, r["rank"]) for r in got] == [("c1", 1)]
    hits = search.top_k(chunks, [1.0, 0.0], 1)
    seeds = search.symbols_of_chunks(hits, symbols)
    assert [(r.chunk_id, r.node) for r in seeds.collect()] == [("c1", "f")]
    near = search.related(seeds, [(edges, "target_id", "source_id", 3)])
    assert [r.node for r in near.collect()] == ["h"]
    assert [(r.chunk_id, r["rank"]) for r in search.chunks_of_symbols(near, symbols, chunks, [1.0, 0.0]).collect()] == [("c3", 1)]


def test_context_of_every_chunk(spark, tmp_path):
    from strataloom.plans.catalogue import QUERIES

    long = "".join(f"line {k} " + "x" * 90 + "\n" for k in range(1, 61))
    spark.createDataFrame([(1, long), (2, "short\ntext"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["chunk_context_all"](spark, str(tmp_path)).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(1, 0), (1, 1800), (1, 3600), (1, 5400), (2, 0)]
    assert rows[-1].context_before == rows[-1].context_after == ""
    lines = long.split("\n")
    for r in rows[:-1]:
        assert r.context_before == "\n".join(lines[max(0, r.start_line - 4) : r.start_line - 1])
        assert r.context_after == "\n".join(lines[r.end_line : r.end_line + 3])
    assert rows[3].start_line > 50


def test_searches_end_only_where_the_graph_does(spark):
    chain = spark.createDataFrame([(k, k + 1, 0.9) for k in range(120)] + [(120, 0, 0.9), (500, 501, 0.9)], "src long, tgt long, conf double").coalesce(1)
    assert traverse.shortest_path(chain, 0, 60).first()["path"] == list(range(61))
    assert traverse.closure_edges(chain, spark.createDataFrame([(0,)], "id long")).count() == 121

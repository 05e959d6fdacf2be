"""A small tree of files through scan, extraction, graph, stores, search and stream."""

import pytest

from strataloom.api import Engine, NotFound
from strataloom.extract.run import extract_one
from strataloom.operators.search import SearchQuery
from strataloom.sources import files as source_files
from strataloom.sources.settings import load
from strataloom.streaming.incremental import FILES, index_stream, session_stream

PYTHON = '''import os
from .utils import hash_password as hp

class Base:
    pass

class User(Base):
    repo: UserRepo

    def __init__(self, store: Store, n=1):
        self.store = store

    @router.get("/x")
    def check(self, x):
        return helper(x)

def helper(x):
    return hash_password(x)
'''
SCRIPT = "import fs, { join } from 'fs';\nconst u = require('./u');\nexport class Dog extends Animal {\n  constructor(private repo: Repo) { bark(); }\n  async run() { return go(1); }\n}\nconst f = async (x) => x;\nfunction top() { return 1; }\n"
RUST = "use crate::a::b;\npub trait Shape: Draw {}\nstruct P { x: i32 }\nimpl P {\n  fn area(&self) -> i32 { a::compute(1) }\n}\nfn main() { run(); }\n"
GO = 'package m\nimport (\n  "fmt"\n  x "a/b"\n)\ntype T struct {}\nfunc (t *T) Go() { fmt.Println(1) }\nfunc Main() {}\n'
JAVA = "import com.x.App;\npublic class A extends B implements C {\n  @Autowired\n  private Repo repo;\n  public int run(int x) { return helper(x); }\n}\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in {"pkg/user.py": PYTHON, "pkg/utils.py": "def hash_password(x):\n    return x\n", "app.ts": SCRIPT, "m.rs": RUST, "m.go": GO, "A.java": JAVA, "node_modules/x.js": "x()", "notes.md": "hello", "blank.py": " \n"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (root / "bin.py").write_bytes(b"a\0b")
    return root


def names(found, what, at=0):
    return [x[at] for x in found[what]]


def test_extractors():
    py = extract_one("python", PYTHON)
    assert names(py, "imports") == ["os", ".utils"] and {(s[0], s[1], s[2]) for s in py["symbols"]} >= {("User", "class", None), ("check", "method", "User"), ("helper", "function", None)}
    assert ("User", "Base", 7) in py["bases"] and {(i[1], i[2]) for i in py["injections"]} == {("UserRepo", "repo"), ("Store", "store")}
    assert names(py, "calls") == ["helper", "hash_password"]  # get is noise
    js = extract_one("typescript", SCRIPT)
    assert names(js, "imports") == ["fs", "./u"] and {(s[0], s[1]) for s in js["symbols"]} >= {("Dog", "class"), ("run", "method"), ("f", "function"), ("top", "function")}
    assert js["bases"][0][:2] == ("Dog", "Animal") and js["injections"][0][:3] == ("Dog", "Repo", "repo") and {"bark", "go"} <= set(names(js, "calls"))
    rs = extract_one("rust", RUST)
    assert names(rs, "imports") == ["crate::a::b"] and ("Shape", "Draw") == rs["bases"][0][:2] and {(s[0], s[1], s[2]) for s in rs["symbols"]} >= {("area", "method", "P"), ("main", "function", None), ("P", "struct", None)}
    go = extract_one("go", GO)
    assert [(i[0], i[2]) for i in go["imports"]] == [("fmt", None), ("a/b", "x")] and {(s[0], s[1], s[2]) for s in go["symbols"]} == {("T", "struct", None), ("Go", "method", "T"), ("Main", "function", None)}
    java = extract_one("java", JAVA)
    assert names(java, "imports") == ["com.x.App"] and {b[1] for b in java["bases"]} == {"B", "C"} and java["injections"][0][:3] == ("A", "Repo", "repo") and ("run", "method", "A") in {(s[0], s[1], s[2]) for s in java["symbols"]}
    assert extract_one("unknown", "x")["symbols"] == [] and extract_one("python", "")["imports"] == []
    broken = extract_one("python", "def (:\n  x\nclass Y:\n  def z(self):\n    pass\n")
    assert broken["errors"] and ("z", "method", "Y") in {(s[0], s[1], s[2]) for s in broken["symbols"]}


def test_scan(spark, tree):
    rows = source_files.scan(spark, str(tree)).collect()
    assert {r.path for r in rows} == {"pkg/user.py", "pkg/utils.py", "app.ts", "m.rs", "m.go", "A.java"}
    assert source_files.count_files(spark, str(tree)) == 8  # blank and binary files count
    assert {r.language for r in rows} == {"python", "typescript", "rust", "go", "java"}


def test_engine(spark, tree, tmp_path):
    settings = load(env={"CHUNKER_MIN_CHUNK_SIZE": "1", "EMBEDDING_DIMENSIONS": "32"}, dotenv=None)
    engine = Engine(spark, str(tmp_path / "home"), settings)
    first = engine.index_directory(str(tree))
    assert first["files"] == 6 and first["chunks"] > 6
    again = engine.index_directory(str(tree))
    assert again["files_indexed"] == 0 and engine.vectors.read().count() == first["chunks"]
    hits = engine.search(SearchQuery("hash password", 3, language="python"), rerank=True).collect()
    assert hits and hits[0]["rank"] == 1 and all(h.language == "python" for h in hits)
    assert engine.vectors.stats().first()["total_files"] == 6
    assert engine.index_graph(str(tree))["failed"] == 0
    assert {r.name for r in engine.callers("hash_password").collect()} == {"helper"}
    assert {r.name for r in engine.callees("check").collect()} == {"helper"}
    assert len(engine.call_path("check", "hash_password")) == 3
    assert {r.name for r in engine.subclasses("Base").collect()} == {"User"}
    text = engine.context_text("User")
    assert "Inherits from: Base" in text and "Methods: " in text and "File imports: pkg/utils.py" in text
    # the Java method calls a helper too, and the only one there is in all files is the Python one
    reached = engine.impact("hash_password")["callers"].join(engine.graph.read("symbols"), "id")
    assert {(r.qualified_name, r.conf) for r in reached.collect()} == {("pkg/user.py::helper", 0.9), ("pkg/user.py::User.check", 0.85), ("A.java::A.run", 0.5)}
    assert engine.find_symbols(decorator="router.").first()["name"] == "check"
    with pytest.raises(NotFound):
        engine.symbol("nothing")
    stats = engine.graph.stats().first()
    assert stats["total_files"] == 6 and stats["edges_by_type"]["CALLS"] >= 2
    assert engine.centrality().count() == stats["total_symbols"]
    hybrid = engine.search_hybrid("hash password", 5).collect()
    assert [r["rank"] for r in hybrid] == list(range(1, len(hybrid) + 1)) and hybrid
    assert engine.delete_file("m.go") > 0
    utils = engine.find_symbols("hash_password").first()["file_id"]
    assert engine.graph.delete_file(utils) == 2 and engine.find_symbols("hash_password").count() == 0


def test_index_stream(spark, tmp_path):
    from strataloom.sources.store import VectorStore

    store, source = VectorStore(spark, str(tmp_path / "vectors")), str(tmp_path / "in")
    for version in ("one", "two"):
        spark.createDataFrame([("a.py", "python", f"def {version}():\n    return 1\n")], FILES).write.mode("append").parquet(source)
        index_stream(spark, source, store, str(tmp_path / "checkpoint")).awaitTermination(60)
    rows = store.read().collect()
    assert len(rows) == 1 and "two" in rows[0].content


def test_session_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0, id * 20 + int(id / 3) * 60) AS ts, 1L AS user_id, 'a' AS event_type, 1.0D AS value FROM range(6)")
    rows.write.parquet(str(tmp_path / "e"))
    batch = session_stream(spark.read.parquet(str(tmp_path / "e"))).select("user_id", F.col("w.start").alias("s"), "n").collect()
    stream = session_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))).select("user_id", F.col("w.start").alias("s"), "n")
    q = stream.writeStream.format("memory").queryName("sessions_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("sessions_out").collect()} == {tuple(r) for r in batch} and sorted(r.n for r in batch) == [3, 3]

"""Queries over a small fixed source tree, and over functions of names and spans, with their SQL.

What extraction finds in the tree is told in SQL as VALUES, written down by reading the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.run import extract, rows
from ..functions import ids, text
from ..operators import build, resolve, traverse
from ..sources.files import finish
from . import fixtures as fx
from .catalogue import query
from .fixtures import EDGES, HUB, table

TREE = {
    "app/models.py": ("python", """import os
from .base import Base, Mixin as M


class User(Base, M):
    repo: Repository

    def __init__(self, mailer: Optional[Mailer]):
        self.mailer = mailer

    @property
    def name(self):
        return format_name(self.first)


async def load(path):
    user = User(None)
    return user.save()
"""),
    "app/base.py": ("python", """class Base:
    def save(self):
        return persist(self)


class Mixin:
    pass


class Repository:
    pass


def format_name(first):
    return first
"""),
    "web/view.ts": ("typescript", """import { Api, get as fetchOne } from "./api";
import React from "react";

export class View extends Base {
  constructor(private api: Api) {
    super();
  }

  render(id: string) {
    return fetchOne(id);
  }
}

export function main() {
  draw(1);
}
"""),
    "web/api.ts": ("typescript", """export class Api {
  send(n: number) {
    return post(n);
  }
}
"""),
    "web/tool.js": ("javascript", """const fs = require("fs");
import "./side.js";

class Tool extends Thing {
  run() {
    this.prepare();
    start(1);
  }
}

function start(n) {
  return helper(n);
}
"""),
    "src/lib.rs": ("rust", """use crate::store::Table;
use std::fmt;

pub struct Engine {
    rows: u32,
}

impl Engine {
    fn show(&self) -> String {
        paint(self)
    }
}

pub fn open(path: &str) -> Engine {
    let t = Table::fetch(path);
    assemble(t)
}

trait Shape: Solid {
    fn area(&self) -> f64;
}
"""),
    "src/store.rs": ("rust", "pub struct Table {\n    n: u32,\n}\n"),
    "cmd/main.go": ("go", """package main

import (
\t"fmt"
\tst "example.com/store"
)

type Server struct {
\tname string
}

func (s *Server) Run(n int) error {
\treturn st.Open(n)
}

func main() {
\tserve(1)
}
"""),
    "java/App.java": ("java", """import java.util.List;
import com.acme.Store;

public class App extends Base implements Runnable {
    @Autowired
    private Store store;

    public void run() {
        store.open();
        prepare(1);
    }
}

interface Shape {
    double area();
}
"""),
    "com/acme/Store.java": ("java", "public class Store {\n}\n"),
}


def tree(spark: SparkSession) -> DataFrame:
    """The tree as a source files table."""
    made = [(path, language, "utf-8", content, len(content.encode())) for path, (language, content) in sorted(TREE.items())]
    return finish(spark.createDataFrame(made, "path string, language string, encoding string, content string, size_bytes long"), "tree")


def values(columns: str, *found: tuple) -> str:
    """SELECT of rows, with all columns as text but those whose name ends in `line`."""
    kinds = [f"CAST({c} AS {'INTEGER' if c.endswith('line') else 'VARCHAR'}) AS {c}" for c in columns.split()]
    told = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in found)
    return f"SELECT {', '.join(kinds)} FROM (VALUES {told}) AS t({', '.join(columns.split())})"


@query(values("path module names alias is_relative line",
    ("app/models.py", "os", "", None, "false", 1), ("app/models.py", ".base", "Base,Mixin", None, "true", 2),
    ("web/view.ts", "./api", "Api,get", "fetchOne", "true", 1), ("web/view.ts", "react", "React", None, "false", 2),
    ("web/tool.js", "fs", "fs", None, "false", 1), ("web/tool.js", "./side.js", "", None, "true", 2),
    ("src/lib.rs", "crate::store::Table", "", None, "false", 1), ("src/lib.rs", "std::fmt", "", None, "false", 2),
    ("cmd/main.go", "fmt", "", None, "false", 4), ("cmd/main.go", "example.com/store", "", "st", "false", 5),
    ("java/App.java", "java.util.List", "List", None, "false", 1), ("java/App.java", "com.acme.Store", "Store", None, "false", 2)))
def extract_imports(spark, d):
    return rows(extract(tree(spark)), "imports").select("path", "module", F.array_join("names", ",").alias("names"), "alias", F.col("is_relative").cast("string").alias("is_relative"), "line")


@query(values("path callee line",
    ("app/models.py", "format_name", 13), ("app/models.py", "User", 17), ("app/models.py", "save", 18), ("app/base.py", "persist", 3),
    ("web/view.ts", "fetchOne", 10), ("web/view.ts", "draw", 15), ("web/api.ts", "post", 3), ("web/tool.js", "prepare", 6), ("web/tool.js", "start", 7), ("web/tool.js", "helper", 12),
    ("src/lib.rs", "paint", 10), ("src/lib.rs", "fetch", 15), ("src/lib.rs", "assemble", 16), ("cmd/main.go", "Open", 13), ("cmd/main.go", "serve", 17), ("java/App.java", "open", 9), ("java/App.java", "prepare", 10)))
def extract_calls(spark, d):
    return rows(extract(tree(spark)), "calls").select("path", "callee", "line")


_SYMBOLS = (
    ("app/models.py", "User", "class", None, 5, 13, ""), ("app/models.py", "__init__", "method", "User", 8, 9, ""), ("app/models.py", "name", "method", "User", 12, 13, "property"), ("app/models.py", "load", "function", None, 16, 18, ""),
    ("app/base.py", "Base", "class", None, 1, 3, ""), ("app/base.py", "save", "method", "Base", 2, 3, ""), ("app/base.py", "Mixin", "class", None, 6, 7, ""), ("app/base.py", "Repository", "class", None, 10, 11, ""), ("app/base.py", "format_name", "function", None, 14, 15, ""),
    ("web/view.ts", "View", "class", None, 4, 12, ""), ("web/view.ts", "constructor", "method", "View", 5, 7, ""), ("web/view.ts", "render", "method", "View", 9, 11, ""), ("web/view.ts", "main", "function", None, 14, 16, ""),
    ("web/api.ts", "Api", "class", None, 1, 5, ""), ("web/api.ts", "send", "method", "Api", 2, 4, ""),
    ("web/tool.js", "Tool", "class", None, 4, 9, ""), ("web/tool.js", "run", "method", "Tool", 5, 8, ""), ("web/tool.js", "start", "function", None, 11, 13, ""),
    ("src/lib.rs", "Engine", "struct", None, 4, 6, ""), ("src/lib.rs", "show", "method", "Engine", 9, 11, ""), ("src/lib.rs", "open", "function", None, 14, 17, ""), ("src/lib.rs", "Shape", "trait", None, 19, 21, ""), ("src/lib.rs", "area", "method", "Shape", 20, 20, ""), ("src/store.rs", "Table", "struct", None, 1, 3, ""),
    ("cmd/main.go", "Server", "struct", None, 8, 10, ""), ("cmd/main.go", "Run", "method", "Server", 12, 14, ""), ("cmd/main.go", "main", "function", None, 16, 18, ""),
    ("java/App.java", "App", "class", None, 4, 12, ""), ("java/App.java", "run", "method", "App", 8, 11, ""), ("java/App.java", "Shape", "interface", None, 14, 16, ""), ("java/App.java", "area", "method", "Shape", 15, 15, ""), ("com/acme/Store.java", "Store", "class", None, 1, 2, ""),
)


@query(values("path name kind parent_name start_line end_line decorators", *_SYMBOLS))
def extract_symbols(spark, d):
    return rows(extract(tree(spark)), "symbols").select("path", "name", "kind", "parent_name", "start_line", "end_line", F.array_join("decorators", ",").alias("decorators"))


@query(values("path child base line", ("app/models.py", "User", "Base", 5), ("app/models.py", "User", "M", 5), ("web/view.ts", "View", "Base", 4), ("web/tool.js", "Tool", "Thing", 4), ("src/lib.rs", "Shape", "Solid", 19), ("java/App.java", "App", "Base", 4), ("java/App.java", "App", "Runnable", 4)))
def extract_inheritance(spark, d):
    return rows(extract(tree(spark)), "bases").select("path", "child", "base", "line")


@query(values("path class_name type_name field_name line", ("app/models.py", "User", "Repository", "repo", 6), ("app/models.py", "User", "Mailer", "mailer", 8), ("web/view.ts", "View", "Api", "api", 5), ("java/App.java", "App", "Store", "store", 6)))
def extract_injections(spark, d):
    return rows(extract(tree(spark)), "injections").select("path", "class_name", "type_name", "field_name", "line")


@query(values("path type name start_line end_line", *((p, {"method": "function"}.get(k, k) if p.endswith(".py") else k, n, a, b) for p, n, k, _, a, b, _ in _SYMBOLS)))
def extract_nodes(spark, d):
    return rows(extract(tree(spark)), "nodes").select("path", "type", "name", "start_line", "end_line")


def _named(spark, rel_type: str) -> DataFrame:
    """Edges of one type of the tree's graph, by the names of their ends."""
    graph = build.build_graph(tree(spark))
    names = graph["symbols"].select("id", F.concat_ws("::", "file_path", F.concat(F.coalesce(F.concat("parent_name", F.lit(".")), F.lit("")), "name")).alias("name")).union(graph["files"].select("id", F.col("path"))).union(graph["directories"].select("id", F.concat("path", F.lit("/"))))
    edges = graph["edges"].filter(F.col("rel_type") == rel_type)
    return edges.join(names.withColumnsRenamed({"id": "source_id", "name": "source"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "name": "target"}), "target_id").select("source", "target")


def _qualified(p: str, parent: str | None, n: str) -> str:
    return f"{p}::{parent + '.' if parent else ''}{n}"


@query(values("source target", *((p, _qualified(p, parent, n)) for p, n, _, parent, *_ in _SYMBOLS)))
def graph_defines(spark, d):
    return _named(spark, "DEFINES")


@query(values("source target", *((_qualified(p, None, parent), _qualified(p, parent, n)) for p, n, _, parent, *_ in _SYMBOLS if parent)))
def graph_contains(spark, d):
    return _named(spark, "CONTAINS")


@query(values("source target", ("app/models.py", "app/base.py"), ("web/view.ts", "web/api.ts"), ("java/App.java", "com/acme/Store.java")))
def graph_imports(spark, d):
    return _named(spark, "IMPORTS").filter("source <> target")


@query(values("source target", ("app/models.py::User.name", "app/base.py::format_name"), ("app/models.py::load", "app/models.py::User"), ("app/models.py::load", "app/base.py::Base.save"), ("web/tool.js::Tool.run", "web/tool.js::start"), ("java/App.java::App.run", "src/lib.rs::open")))
def graph_calls(spark, d):
    return _named(spark, "CALLS")


@query(values("source target", ("app/models.py::User", "app/base.py::Base"), ("web/view.ts::View", "app/base.py::Base"), ("java/App.java::App", "app/base.py::Base")))
def graph_inherits(spark, d):
    return _named(spark, "INHERITS_FROM")


@query(values("source target", ("app/models.py::User", "app/base.py::Repository"), ("web/view.ts::View", "web/api.ts::Api"), ("java/App.java::App", "com/acme/Store.java::Store")))
def graph_injects(spark, d):
    return _named(spark, "INJECTS")


_FILES = "a/b/c.py a/b/__init__.py a/d.ts a/e/index.ts src/x/mod.rs src/y.rs src/x/z.rs com/q/R.java lib/only.py".split()
_IMPORTS = (
    (1, "a/m.py", "a.b.c", "python", "a/b/c.py"), (2, "a/m.py", "a.b.c.name", "python", "a/b/c.py"), (3, "a/b/k.py", ".c", "python", "a/b/c.py"), (4, "a/b/k.py", "..b", "python", "a/b/__init__.py"), (5, "a/m.py", "only", "python", "lib/only.py"), (6, "a/m.py", "numpy", "python", None),
    (7, "a/m.ts", "./d", "typescript", "a/d.ts"), (8, "a/m.ts", "./e", "typescript", "a/e/index.ts"), (9, "a/e/m.js", "../d", "javascript", "a/d.ts"), (10, "a/m.ts", "d", "typescript", None),
    (11, "src/m.rs", "crate::x", "rust", "src/x/mod.rs"), (12, "src/x/m.rs", "self::z", "rust", "src/x/z.rs"), (13, "src/x/m.rs", "super::y", "rust", "src/y.rs"), (14, "src/m.rs", "std::fmt", "rust", None),
    (15, "com/q/S.java", "com.q.R", "java", "com/q/R.java"), (16, "com/q/S.java", "q.R", "java", "com/q/R.java"), (17, "com/q/S.java", "java.util.List", "java", None),
)


@query(values("import_id target", *((str(i), t) for i, _, _, _, t in _IMPORTS)))
def import_resolution(spark, d):
    files = spark.createDataFrame([(p, p) for p in _FILES], "file_id string, path string")
    imports = spark.createDataFrame([r[:4] for r in _IMPORTS], "import_id long, path string, module string, language string")
    return resolve.resolve_imports(imports, files).select(F.col("import_id").cast("string").alias("import_id"), "target")


# functions over whole tables

@query("SELECT p_partkey, CAST(greatest(1, ceil(greatest(1, (p_size + p_partkey % 40) - p_size + 1) * 15.0)) AS BIGINT) AS tokens FROM part")
def span_token_estimate(spark, d):
    return table(spark, d, "part").select("p_partkey", text.span_tokens(F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 40).alias("tokens"))


@query("SELECT user_id, round(CASE WHEN done + failed = 0 THEN 1.0 ELSE done / (done + failed) END, 6) AS rate FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'click') AS failed FROM events GROUP BY 1)")
def success_rate(spark, d):
    counted = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "click").alias("failed"))
    return counted.select("user_id", F.round(text.success_rate(F.col("done"), F.col("failed"), 1.0), 6).alias("rate"))


@query("SELECT p_partkey, '{\"name\": \"' || p_name || '\"}' AS answer FROM part")
def json_fence(spark, d):
    fenced = F.concat(F.when(F.col("p_partkey") % 3 == 0, "```json\n").when(F.col("p_partkey") % 3 == 1, "  ```\n").otherwise(""), F.lit('{"name": "'), "p_name", F.lit('"}'), F.when(F.col("p_partkey") % 3 < 2, "\n```").otherwise(" "))
    return table(spark, d, "part").select("p_partkey", text.unfenced(fenced).alias("answer"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 4 THEN NULL ELSE 'T' || p_size END AS type FROM part")
def type_unwrap(spark, d):
    name, k = F.concat(F.lit("T"), F.col("p_size").cast("string")), F.col("p_partkey") % 6
    shown = F.when(k == 0, F.concat(F.lit("Optional["), name, F.lit("]"))).when(k == 1, F.concat(F.lit("typing.List["), name, F.lit("]"))).when(k == 2, F.concat(name, F.lit(" | None"))).when(k == 3, F.concat(F.lit("Union["), name, F.lit(", int]"))).when(k == 4, F.lit("str")).otherwise(name)
    return table(spark, d, "part").select("p_partkey", text.unwrap_type(shown).alias("type"))


@query("""SELECT p_partkey, p_brand || '::' || CASE WHEN p_partkey % 2 = 0 THEN p_type || '.' ELSE '' END || p_name AS qualified,
substr(sha256(substr(sha256(p_brand), 1, 16) || ':' || p_name), 1, 16) AS symbol_id, substr(sha256('CALLS:' || p_partkey || ':' || p_size), 1, 16) AS edge_id FROM part""")
def graph_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.qualified_name(F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.col("p_name")).alias("qualified"), ids.symbol_id(ids.file_id("p_brand"), "p_name").alias("symbol_id"), ids.edge_id(F.lit("CALLS"), F.col("p_partkey"), F.col("p_size")).alias("edge_id"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256('doc/' || doc_id), 1, 15)) AS BIGINT) AS point FROM documents")
def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.point_id(F.sha2(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), 256)).alias("point"))


@query(f"WITH {EDGES}, {HUB} SELECT DISTINCT src AS id, 'certain' AS rel FROM edges WHERE conf = 0.9 AND tgt = (SELECT id FROM hub) UNION ALL SELECT DISTINCT tgt, 'probable' FROM edges WHERE conf = 0.85 AND src = (SELECT id FROM hub)")
def neighbours_by_type(spark, d):
    edges = fx.edges(spark, d).withColumn("rel_type", F.when(F.col("conf") == 0.9, "certain").when(F.col("conf") == 0.85, "probable").otherwise("weak"))
    start = fx.hub(spark, d)
    far = traverse.neighbours(edges, start, "certain", outgoing=False).withColumn("rel", F.lit("certain"))
    return far.union(traverse.neighbours(edges, start, "probable").withColumn("rel", F.lit("probable")))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS n_lines, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL")
def line_counts(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.when((F.col("text") == "") | F.endswith("text", F.lit("\n")), 0).otherwise(1)).cast("long").alias("n_lines"), F.octet_length("text").cast("long").alias("n_bytes"))

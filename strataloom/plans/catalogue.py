"""Registered queries and their SQL: each query applies an operator to whole tables, and DuckDB answers the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, text, vectors
from ..lineage import settle
from ..operators import chunking, knapsack, render, resolve, search, terms, traverse
from ..operators.centrality import katz
from ..sources import store
from ..sources.files import changed, finish, ignored
from ..sources.languages import REGISTRY
from . import fixtures as fx
from .fixtures import CALLS, EDGES, HUB, IMPORTS, SYMBOLS, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# vectors

_E = "[CAST(x AS DOUBLE) FOR x IN embedding]"
_COS = "list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v)))"
_VEC = f"e AS (SELECT vec_id, label, {_E} AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 0)"


def _top(score: str, k: int, where: str = "true", least: str = "true") -> str:
    return f"""WITH {_VEC}, s AS (SELECT e.vec_id, {score} AS s FROM e, q WHERE {where}),
t AS (SELECT vec_id, s, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT vec_id, round(s, 6) AS score, rank FROM t WHERE rank <= {k} AND {least}"""


def _hits(spark, d, k, where=None, **options):
    rows = table(spark, d, "embeddings")
    return search.top_k(rows, fx.vector_of(spark, d, 0), k, where, key="vec_id", **options)


_OUT = ("vec_id", "round(score, 6) AS score", "rank")


@query(_top(_COS, 10))
def vector_topk(spark, d):
    return _hits(spark, d, 10).selectExpr(*_OUT)


@query(_top(_COS, 10, "label = 3"))
def vector_topk_filtered(spark, d):
    return _hits(spark, d, 10, [F.col("label") == 3]).selectExpr(*_OUT)


@query(_top(_COS, 20, least="s >= 0.2"))
def vector_min_score(spark, d):
    return search.above(_hits(spark, d, 20), 0.2).selectExpr(*_OUT)


@query(_top("list_dot_product(e.v, q.v)", 10))
def vector_metric_dot(spark, d):
    return _hits(spark, d, 10, metric="dot").selectExpr(*_OUT)


@query(_top("-list_distance(e.v, q.v)", 10))
def vector_metric_l2(spark, d):
    return _hits(spark, d, 10, metric="euclidean").selectExpr(*_OUT)


@query(_top(f"greatest(0, ({_COS} + 1) / 2)", 10))
def vector_unit_scale(spark, d):
    return _hits(spark, d, 10, scale="unit").selectExpr(*_OUT)


@query(f"""WITH {_VEC.split(', q AS')[0]}, s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS s FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
t AS (SELECT query_id, vec_id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM t WHERE rank <= 5""")
def vector_all_pairs_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return search.batch_top_k(rows, rows.filter("vec_id % 20 = 0"), 5, key="vec_id").selectExpr("query_id", *_OUT)


@query(f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(sqrt(list_dot_product(u, u)), 6) AS unit FROM (SELECT vec_id, v, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM (SELECT vec_id, {_E} AS v FROM embeddings))")
def embedding_l2norm(spark, d):
    v = vectors.as_double("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.norm(vectors.normalized(v)), 6).alias("unit"))


@query("SELECT CAST(len(embedding) AS INTEGER) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def embedding_dim(spark, d):
    return table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: len(t) > 0))"


@query(f"""WITH {_VEC}, h AS (SELECT e.vec_id, {_COS} AS s FROM e, q ORDER BY s DESC, vec_id LIMIT 20),
w AS (SELECT {_WORDS.format('text')} AS w FROM benchmark WHERE item_id = 0),
r AS (SELECT h.vec_id, len(list_intersect(w.w, {_WORDS.format('d.text')})) / greatest(len(w.w), 1) AS s FROM h JOIN documents d ON d.doc_id = h.vec_id, w),
t AS (SELECT vec_id, s, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM r)
SELECT vec_id, round(s, 6) AS score, rank FROM t WHERE rank <= 10""")
def two_stage_rerank(spark, d):
    wanted = table(spark, d, "benchmark").filter("item_id = 0").first()["text"]
    rows = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    q = search.SearchQuery(query=wanted, top_k=10)
    return search.two_stage(rows, fx.vector_of(spark, d, 0), q, search.token_overlap(wanted, "text"), key="vec_id").filter("text is not null").selectExpr(*_OUT)


_TWO = f"""WITH {_VEC}, q2 AS (SELECT v FROM e WHERE vec_id = 1),
a AS (SELECT vec_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM e, q),
b AS (SELECT vec_id, row_number() OVER (ORDER BY {_COS.replace('q.v', 'q2.v')} DESC, vec_id) AS rank FROM e, q2),
u AS (SELECT vec_id, rank, 0 AS l FROM a WHERE rank <= 40 UNION ALL SELECT vec_id, rank, 1 FROM b WHERE rank <= 40)"""


@query(_TWO + """, f AS (SELECT vec_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(struct_pack(l := l, r := rank)) AS first FROM u GROUP BY vec_id)
SELECT vec_id, round(s, 9) AS score, CAST(row_number() OVER (ORDER BY round(s, 12) DESC, first.l, first.r, vec_id) AS INTEGER) AS rank FROM f ORDER BY rank LIMIT 20""")
def rrf_merge(spark, d):
    a = _hits(spark, d, 40).select("vec_id", "rank")
    b = search.top_k(table(spark, d, "embeddings"), fx.vector_of(spark, d, 1), 40, key="vec_id").select("vec_id", "rank")
    return search.reciprocal_rank_fusion([a, b], "vec_id", k=20).select("vec_id", F.round("score", 9).alias("score"), "rank")


_HYBRID = f"""WITH {EDGES}, {_VEC}, h AS (SELECT vec_id AS node, rank FROM (SELECT vec_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM e, q) WHERE rank <= 20),
n AS (SELECT DISTINCT rank, 0 AS side, src AS near FROM h JOIN edges ON tgt = node WHERE rank <= 10 UNION SELECT DISTINCT rank, 1, tgt FROM h JOIN edges ON src = node WHERE rank <= 10),
n2 AS (SELECT *, row_number() OVER (PARTITION BY rank, side ORDER BY near) AS n FROM n),
n3 AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY side, n, near) AS m FROM n2 WHERE n <= 3 AND near NOT IN (SELECT node FROM h WHERE rank <= 10)),
x AS (SELECT near AS node, min(rank * 100 + m) AS first FROM n3 WHERE m <= 3 GROUP BY near),
x2 AS (SELECT node, row_number() OVER (ORDER BY first, node) AS rank FROM x),
u AS (SELECT node, rank, 0 AS l FROM h UNION ALL SELECT node, rank, 1 FROM x2 WHERE node NOT IN (SELECT node FROM h)),
f AS (SELECT node, sum(1.0::DOUBLE / (60 + rank)) AS s, min(struct_pack(l := l, r := rank)) AS first FROM u GROUP BY node)
SELECT node, round(s, 9) AS score, CAST(row_number() OVER (ORDER BY round(s, 12) DESC, first.l, first.r, node) AS INTEGER) AS rank FROM f ORDER BY rank LIMIT 10"""


@query(_HYBRID)
def hybrid_expand(spark, d):
    rows = table(spark, d, "embeddings")
    return search.hybrid(rows, fx.vector_of(spark, d, 0), fx.edges(spark, d), 10, key="vec_id").select("node", F.round("score", 9).alias("score"), "rank")


FLAGSHIP = hybrid_expand


# graph

_NODES = "nodes AS (SELECT p_partkey AS id FROM part)"
_KATZ = f"WITH {EDGES}, {_NODES}, w AS (SELECT src, tgt, count(*)::DOUBLE AS w FROM edges JOIN nodes ON id = src GROUP BY 1, 2), k0 AS (SELECT id, 0.0::DOUBLE AS raw FROM nodes)" + "".join(
    f", k{i} AS MATERIALIZED (SELECT n.id, 1.0::DOUBLE + 0.1 * coalesce(s.x, 0) AS raw FROM nodes n LEFT JOIN (SELECT tgt, sum(w.w * k.raw) AS x FROM w JOIN k{i - 1} k ON k.id = w.src GROUP BY tgt) s ON s.tgt = n.id)" for i in range(1, 11)
)


def _katz(spark, d):
    return katz(table(spark, d, "part").select(F.col("p_partkey").alias("id")), fx.edges(spark, d), most=10, tolerance=0)


@query(_KATZ + " SELECT id, round(raw, 6) AS raw, round((raw - lo) / (hi - lo), 6) AS katz FROM k10, (SELECT min(raw) AS lo, max(raw) AS hi FROM k10)")
def katz_centrality(spark, d):
    return _katz(spark, d).select("id", F.round("raw", 6).alias("raw"), F.round("katz", 6).alias("katz"))


@query(_KATZ + f", c AS (SELECT id, (raw - lo) / (hi - lo) AS katz FROM k10, (SELECT min(raw) AS lo, max(raw) AS hi FROM k10)), {_VEC} SELECT e.vec_id, round(0.6 * ({_COS}) + 0.4 * c.katz, 6) AS score FROM e JOIN c ON c.id = e.vec_id, q")
def score_blend(spark, d):
    rows = table(spark, d, "embeddings").join(_katz(spark, d), F.col("vec_id") == F.col("id"))
    cosine = vectors.score(vectors.as_double("embedding"), vectors.literal(fx.vector_of(spark, d, 0)))
    return rows.select("vec_id", F.round(search.blend(cosine, F.col("katz")), 6).alias("score"))


def _walk(depth: int, here: str, there: str) -> str:
    levels = "".join(f", l{i} AS (SELECT DISTINCT e.{there} AS id FROM edges e JOIN l{i - 1} p ON p.id = e.{here})" for i in range(1, depth + 1))
    union = " UNION ALL ".join(f"SELECT id, {i} AS depth FROM l{i}" for i in range(depth + 1))
    return f"WITH {EDGES}, {HUB}, l0 AS (SELECT id FROM hub){levels}, a AS ({union}) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM a GROUP BY id HAVING min(depth) > 0"


@query(_walk(1, "tgt", "src"))
def callers_k1(spark, d):
    return traverse.callers(fx.edges(spark, d), fx.hub(spark, d), 1)


@query(_walk(3, "tgt", "src"))
def callers_k3(spark, d):
    return traverse.callers(fx.edges(spark, d), fx.hub(spark, d), 3)


@query(_walk(2, "src", "tgt"))
def callees_k2(spark, d):
    return traverse.callees(fx.edges(spark, d), fx.hub(spark, d), 2)


_PATHS = f"""WITH RECURSIVE {EDGES}, {HUB}, p AS (SELECT id, [id] AS path, 0 AS n FROM hub
UNION SELECT e.tgt, list_append(p.path, e.tgt), n + 1 FROM p JOIN edges e ON e.src = p.id WHERE n < 8 AND NOT list_contains(p.path, e.tgt)),
goal AS (SELECT max(id) AS id FROM p WHERE n = 3) """


@query(_PATHS + "SELECT array_to_string(min(path), '>') AS path FROM p WHERE id = (SELECT id FROM goal) AND n = (SELECT min(n) FROM p WHERE id = (SELECT id FROM goal)) HAVING min(path) IS NOT NULL")
def call_path(spark, d):
    start = fx.hub(spark, d).first()["id"]
    rel = fx.edges(spark, d)
    # the largest node at the end of a path of three steps without a repeat
    steps = rel.select("src", "tgt").distinct()
    path = spark.createDataFrame([(start, [start])], "id long, path array<long>")
    for _ in range(3):
        path = path.join(steps, F.col("id") == F.col("src")).filter(~F.array_contains("path", F.col("tgt"))).select(F.col("tgt").alias("id"), F.concat("path", F.array("tgt")).alias("path"))
    goal = path.agg(F.max("id")).first()[0]
    return traverse.shortest_path(rel, start, goal).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"WITH RECURSIVE {EDGES}, {HUB}, r AS (SELECT id FROM hub UNION SELECT e.tgt FROM r JOIN edges e ON e.src = r.id) SELECT src, array_to_string(list_sort(list(DISTINCT tgt)), ',') AS targets FROM edges WHERE src IN (SELECT id FROM r) GROUP BY src")
def import_closure(spark, d):
    reached = traverse.adjacency(traverse.closure_edges(fx.edges(spark, d), fx.hub(spark, d)))
    return reached.select("src", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


_WIDEST = f"WITH RECURSIVE {EDGES}, {HUB}, r AS (SELECT id, 1.0::DOUBLE AS conf FROM hub UNION SELECT e.src, least(r.conf, e.conf::DOUBLE) FROM r JOIN edges e ON e.tgt = r.id), best AS (SELECT id, max(conf) AS conf FROM r WHERE id NOT IN (SELECT id FROM hub) GROUP BY id)"


@query(_WIDEST + " SELECT id, conf FROM best")
def impact_set(spark, d):
    return _impact(spark, d)["callers"].select(F.col("id").cast("long").alias("id"), "conf")


@query(_WIDEST + " SELECT count(*) FILTER (conf >= 0.85) AS certain, count(*) FILTER (conf >= 0.5 AND conf < 0.85) AS probable, count(*) FILTER (conf < 0.5) AS speculative FROM best")
def impact_breakdown(spark, d):
    return _impact(spark, d)["breakdown"]


@query(_WIDEST + " SELECT DISTINCT p_brand AS file FROM part JOIN best ON best.id = p_partkey")
def affected_files(spark, d):
    return _impact(spark, d)["affected_files"].select(F.col("path").alias("file"))


@query(f"WITH {EDGES} SELECT 'edges' AS what, CAST(conf AS VARCHAR) AS value, count(*) AS n FROM (SELECT CAST(conf * 100 AS INTEGER) AS conf FROM edges) GROUP BY 2 UNION ALL SELECT 'kind', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'file', p_brand, count(*) FROM part GROUP BY 2")
def graph_stats(spark, d):
    part = table(spark, d, "part")
    edges = fx.edges(spark, d).select(F.round(F.col("conf") * 100).cast("int").cast("string").alias("rel_type"))
    row = store.graph_stats({"files": part.select(F.col("p_brand").alias("language")), "symbols": part.select(F.col("p_type").alias("kind")), "directories": part.limit(0), "edges": edges})

    def counts(what, column):
        return F.transform(F.map_entries(column), lambda e: F.struct(F.lit(what).alias("what"), e["key"].alias("value"), e["value"].alias("n")))

    counted = F.concat(counts("edges", "edges_by_type"), counts("kind", "symbols_by_kind"), counts("file", "files_by_language"))
    return row.select(F.explode(counted).alias("x")).select("x.*")


def _graph(spark, d):
    """Parts and their edges as symbols, files and typed edges."""
    part = table(spark, d, "part")
    symbols = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.lower("p_type").alias("kind"), F.col("p_brand").alias("file_id"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 9).alias("end_line"), F.lit(None).cast("array<string>").alias("decorators"))
    files = part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("path"), F.lit("python").alias("language")).distinct()
    calls = fx.edges(spark, d).select(F.lit("CALLS").alias("rel_type"), F.col("src").cast("string").alias("source_id"), F.col("tgt").cast("string").alias("target_id"), F.col("conf").alias("confidence"))
    return symbols, files, calls


def _impact(spark, d):
    symbols, files, calls = _graph(spark, d)
    calls = settle(calls)  # every part of the answer reads the edges; they are made once
    return traverse.impact_set(calls, symbols, files, str(fx.hub(spark, d).first()["id"]))


_AROUND = f"""WITH {EDGES}, {HUB}, hs AS (SELECT p.* FROM part p JOIN hub ON hub.id = p.p_partkey),
up AS (SELECT list_sort(list(struct_pack(name := p_name, kind := lower(p_type), q := p_brand || '::' || p_name))) AS l FROM part WHERE p_partkey IN (SELECT src FROM edges WHERE tgt = (SELECT id FROM hub))),
dn AS (SELECT list_sort(list(struct_pack(name := p_name, kind := lower(p_type), q := p_brand || '::' || p_name))) AS l FROM part WHERE p_partkey IN (SELECT tgt FROM edges WHERE src = (SELECT id FROM hub))) """


def _context(spark, d):
    symbols, files, calls = _graph(spark, d)
    return traverse.symbol_context(calls, symbols, files, str(fx.hub(spark, d).first()["id"]))


@query(_AROUND + "SELECT CAST(p_partkey AS VARCHAR) AS id, array_to_string([x.name FOR x IN up.l], ',') AS callers, array_to_string([x.name FOR x IN dn.l], ',') AS callees FROM hs, up, dn")
def symbol_context(spark, d):
    # a side without anything is null, as DuckDB's list() over no rows is
    return _context(spark, d).select("id", *[F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["name"]), ",")).alias(c) for c in ("callers", "callees")])


@query(_AROUND + """SELECT concat_ws(chr(10), 'Symbol: ' || p_brand || '::' || p_name || ' [' || lower(p_type) || ']', 'File: ' || p_brand || ' (lines ' || p_size || '–' || (p_size + 9) || ')',
CASE WHEN len(dn.l) > 0 THEN 'Calls: ' || array_to_string([x.name FOR x IN dn.l[1:10]], ', ') END, CASE WHEN len(up.l) > 0 THEN 'Called by: ' || array_to_string([x.name FOR x IN up.l[1:10]], ', ') END) AS text FROM hs, up, dn""")
def context_text(spark, d):
    return _context(spark, d).select(render.context_text().alias("text"))


@query(_AROUND + """SELECT array_to_string(list_concat(['flowchart TD', '    focal["' || p_name || ' [' || lower(p_type) || ']"]'],
 [ '    caller' || (i - 1) || '["' || up.l[i].name || ' [' || up.l[i].kind || ']"]' || chr(10) || '    caller' || (i - 1) || ' -->|calls| focal' FOR i IN range(1, least(len(up.l), 8) + 1)],
 [ '    callee' || (i - 1) || '["' || dn.l[i].name || ' [' || dn.l[i].kind || ']"]' || chr(10) || '    focal -->|calls| callee' || (i - 1) FOR i IN range(1, least(coalesce(len(dn.l), 0), 8) + 1)]), chr(10)) AS diagram FROM hs, up, dn""")
def context_mermaid(spark, d):
    return _context(spark, d).select(render.context_mermaid().alias("diagram"))


# joins

@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day FROM events),
s AS (SELECT user_id, day, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1, 2 UNION ALL SELECT user_id, date_trunc('month', day), min(ts), max(ts) FROM e GROUP BY 1, 2),
n AS (SELECT user_id, a, b, CAST(day AS VARCHAR) AS d0, epoch_us(a) AS sa, epoch_us(b) AS sb FROM s),
j AS (SELECT e.event_id, n.sb - n.sa AS size, n.sa AS start, row_number() OVER (PARTITION BY e.event_id ORDER BY n.sb - n.sa, n.sa) AS r FROM e JOIN n ON n.user_id = e.user_id AND e.ts BETWEEN n.a AND n.b)
SELECT event_id, start, size FROM j WHERE r = 1""")
def enclosing_symbol(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = e.groupBy("user_id", "day").agg(F.min("at").alias("a"), F.max("at").alias("b")).drop("day")
    spans = spans.union(e.groupBy("user_id", F.trunc("day", "month")).agg(F.min("at"), F.max("at")).select("user_id", F.col("min(at)"), F.col("max(at)")))
    spans = spans.withColumn("span_id", F.struct("a", "b"))
    out = resolve.enclosing(e, spans, "user_id", "at", "event_id", "span_id", "a", "b")
    return out.select("event_id", F.col("span_id.a").alias("start"), (F.col("span_id.b") - F.col("span_id.a")).alias("size"))


@query(f"""WITH {SYMBOLS}, {IMPORTS}, {CALLS}, last AS (SELECT file_id, name, max(id) AS id FROM symbols GROUP BY 1, 2),
w AS (SELECT DISTINCT file_id, callee FROM calls), im AS (SELECT w.file_id, w.callee, count(*) AS n, min(l.id) AS id FROM w JOIN links k ON k.file_id = w.file_id JOIN last l ON l.file_id = k.target AND l.name = w.callee GROUP BY 1, 2),
g AS (SELECT name, count(*) AS n, min(id) AS id FROM symbols GROUP BY 1),
r AS (SELECT c.call_id, c.caller_id, CASE WHEN o.id IS NOT NULL THEN 'same_file' WHEN im.n = 1 THEN 'imported' WHEN im.n > 1 THEN 'ambiguous_imported' WHEN g.n = 1 THEN 'global' WHEN g.n > 1 THEN 'ambiguous_global' ELSE 'unknown' END AS tier, o.id AS o, im.id AS i, g.id AS g
  FROM calls c LEFT JOIN last o ON o.file_id = c.file_id AND o.name = c.callee LEFT JOIN im ON im.file_id = c.file_id AND im.callee = c.callee LEFT JOIN g ON g.name = c.callee),
t AS (SELECT *, CASE tier WHEN 'same_file' THEN o WHEN 'imported' THEN i WHEN 'global' THEN g END AS callee_id FROM r)
SELECT call_id, caller_id, CASE WHEN callee_id = caller_id THEN 'self' ELSE tier END AS tier, callee_id, CAST(CASE WHEN callee_id IS NULL THEN NULL WHEN tier = 'same_file' THEN 0.85 WHEN tier = 'imported' THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM t""")
def call_resolution_tiers(spark, d):
    return resolve.resolve_calls(fx.calls(spark, d), fx.symbols(spark, d), fx.imports(spark, d)).select("call_id", "caller_id", "tier", "callee_id", "confidence")


@query(f"WITH {SYMBOLS}, {IMPORTS}, o AS (SELECT id AS child_id, file_id, list_extract(string_split(name, ' '), 1) AS word FROM symbols), b AS (SELECT o.child_id, o.file_id, s.name AS base FROM o JOIN symbols s ON s.id = o.child_id + 1)," + """
c AS (SELECT b.child_id, b.base, s.id AS parent_id, row_number() OVER (PARTITION BY b.child_id, b.base ORDER BY CASE WHEN s.file_id = b.file_id THEN 0 WHEN l.target IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN s.file_id = b.file_id THEN -s.seq ELSE s.seq END) AS r
  FROM b JOIN symbols s ON s.name = b.base AND s.id <> b.child_id LEFT JOIN links l ON l.file_id = b.file_id AND l.target = s.file_id) SELECT DISTINCT child_id, parent_id FROM c WHERE r = 1""")
def inherits_join(spark, d):
    symbols = fx.symbols(spark, d)
    bases = symbols.select((F.col("id") - 1).alias("child_id"), F.col("name").alias("base")).join(symbols.select(F.col("id").alias("child_id"), "file_id"), "child_id")
    return resolve.resolve_bases(bases, symbols, fx.imports(spark, d))


@query(f"WITH {SYMBOLS}, {IMPORTS}, w AS (SELECT o.id AS class_id, o.file_id, s.name AS type_name FROM symbols o JOIN symbols s ON s.id = o.id + 7)," + """
i AS (SELECT w.class_id, w.type_name, s.id AS i, row_number() OVER (PARTITION BY w.class_id, w.type_name ORDER BY s.kind <> 'class', s.seq) AS r FROM w JOIN links l ON l.file_id = w.file_id JOIN symbols s ON s.file_id = l.target AND s.name = w.type_name),
g AS (SELECT name, min(id) AS g FROM symbols GROUP BY 1 HAVING count(*) = 1)
SELECT w.class_id, coalesce(i.i, g.g) AS injected_id FROM w LEFT JOIN i ON i.class_id = w.class_id AND i.type_name = w.type_name AND i.r = 1 LEFT JOIN g ON g.name = w.type_name WHERE coalesce(i.i, g.g) IS NOT NULL AND coalesce(i.i, g.g) <> w.class_id""")
def injects_join(spark, d):
    symbols = fx.symbols(spark, d)
    wanted = symbols.select((F.col("id") - 7).alias("class_id"), F.col("name").alias("type_name"), F.lit("f").alias("field_name")).join(symbols.select(F.col("id").alias("class_id"), "file_id"), "class_id")
    return resolve.resolve_injections(wanted, symbols, fx.imports(spark, d)).select("class_id", "injected_id")


@query(f"WITH {SYMBOLS}, last AS (SELECT file_id, name, max(id) AS id FROM symbols GROUP BY 1, 2), p AS (SELECT s.id, s.file_id, o.name AS parent FROM symbols s JOIN symbols o ON o.id = s.id + 25) SELECT l.id AS parent_id, p.id AS child_id FROM p JOIN last l ON l.file_id = p.file_id AND l.name = p.parent WHERE l.id <> p.id")
def contains_selfjoin(spark, d):
    symbols = fx.symbols(spark, d)
    last = resolve.last_definition(symbols, ["file_id", "name"]).select("file_id", F.col("name").alias("parent"), F.col("id").alias("parent_id"))
    wanted = symbols.select((F.col("id") - 25).alias("child_id"), F.col("name").alias("parent")).join(symbols.select(F.col("id").alias("child_id"), "file_id"), "child_id")
    return wanted.join(last, ["file_id", "parent"]).filter("parent_id <> child_id").select("parent_id", "child_id")


_LINKS = "l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS link FROM pages)"


@query(f"WITH {_LINKS}, f AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\\.[^./]+$', ''), '/') AS p FROM pages), x AS (SELECT page_id, unnest([array_to_string(p[i:], '/') FOR i IN range(1, len(p) + 1)]) AS suffix FROM f), u AS (SELECT suffix, min(page_id) AS target FROM x GROUP BY suffix HAVING count(*) = 1) SELECT DISTINCT l.page_id, l.link, u.target FROM l LEFT JOIN u ON u.suffix = l.link")
def html_link_imports(spark, d):
    pages = table(spark, d, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)).alias("link")).distinct()
    files = pages.select(F.col("page_id").alias("file_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return links.join(resolve.unique_suffixes(files).withColumnRenamed("suffix", "link"), "link", "left").select("page_id", "link", F.col("file_id").alias("target"))


# chunks

_STEP, _SIZE = 1800, 2000
_WIN = f"""w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), {_STEP})) AS start FROM documents WHERE regexp_matches(text, '\\S')),
r AS (SELECT doc_id, text, n, start, substr(text, start + 1, {_SIZE}) AS raw FROM w WHERE start = 0 OR start - {_STEP} + {_SIZE} < n)"""
_WIN_OUT = """ SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + length(c) AS INTEGER) AS end_at, CAST(length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1 AS INTEGER) AS start_line,
CAST(strlen(substr(text, 1, start)) AS INTEGER) AS start_byte, sha256(c) AS sha FROM x WHERE regexp_matches(c, '\\S')"""
_WIN_COLS = ("doc_id", "start", "`end` AS end_at", "start_line", "start_byte", "sha2(chunk, 256) AS sha")


@query(f"WITH {_WIN}, x AS (SELECT doc_id, text, start, raw AS c FROM r)" + _WIN_OUT)
def chunk_sliding(spark, d):
    return chunking.sliding_windows(table(spark, d, "documents"), _SIZE, _SIZE - _STEP, "none").selectExpr(*_WIN_COLS)


@query(f"WITH {_WIN}, a AS (SELECT *, CASE WHEN contains(raw, chr(10)) THEN length(raw) - strpos(reverse(raw), chr(10)) + 1 ELSE 0 END AS cut_at FROM r), x AS (SELECT doc_id, text, start, CASE WHEN start + {_SIZE} < n AND cut_at > 1 THEN substr(raw, 1, cut_at) ELSE raw END AS c FROM a)" + _WIN_OUT)
def chunk_sliding_snap(spark, d):
    return chunking.sliding_windows(table(spark, d, "documents"), _SIZE, _SIZE - _STEP, "end").selectExpr(*_WIN_COLS)


@query("""WITH RECURSIVE l AS (SELECT doc_id, [CASE WHEN i < len(p) THEN p[i] || chr(10) ELSE p[i] END FOR i IN range(1, len(p) + 1) IF i < len(p) OR p[i] <> ''] AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE regexp_matches(text, '\\S'))),
x AS (SELECT doc_id, 0 AS i, 1 AS first, '' AS body, 0::BIGINT AS used, 0 AS no, NULL::VARCHAR AS done, 0 AS done_first FROM l
UNION ALL SELECT x.doc_id, x.i + 1, CASE WHEN used > 0 AND used + c > 256 THEN x.i + 1 ELSE first END, CASE WHEN used > 0 AND used + c > 256 THEN t ELSE body || t END, CASE WHEN used > 0 AND used + c > 256 THEN c ELSE used + c END,
 CASE WHEN used > 0 AND used + c > 256 THEN no + 1 ELSE no END, CASE WHEN used > 0 AND used + c > 256 THEN body ELSE NULL END, CASE WHEN used > 0 AND used + c > 256 THEN first ELSE 0 END
 FROM (SELECT x.*, l.lines[x.i + 1] AS t, greatest(1, length(l.lines[x.i + 1]) // 4) AS c FROM x JOIN l ON l.doc_id = x.doc_id WHERE x.i < len(l.lines)) x),
z AS (SELECT doc_id, no - 1 AS no, done_first AS first, i - 1 AS last, done AS body FROM x WHERE done IS NOT NULL UNION ALL SELECT x.doc_id, no, first, i, body FROM x JOIN l ON l.doc_id = x.doc_id WHERE i = len(l.lines) AND used > 0),
y AS (SELECT *, lag(body) OVER (PARTITION BY doc_id ORDER BY no) AS prev FROM z)
SELECT doc_id, CAST(no AS INTEGER) AS chunk_no, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line, sha256(coalesce(right(prev, 128), '') || body) AS sha FROM y WHERE regexp_matches(coalesce(right(prev, 128), '') || body, '\\S')""")
def chunk_token(spark, d):
    return chunking.token_chunks(table(spark, d, "documents"), 256, 32).select("doc_id", "chunk_no", "start_line", "end_line", F.sha2("chunk", 256).alias("sha"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE regexp_matches(text, '\\S')) SELECT doc_id, array_to_string(p[1:3], chr(10)) AS before_4, array_to_string(p[5:7], chr(10)) AS after_4 FROM l WHERE len(p) >= 4""")
def chunk_context(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").rlike(r"\S") & (F.size(F.split("text", "\n")) >= 4))
    at4 = docs.withColumns({"start_line": F.lit(4), "end_line": F.lit(4)})
    return chunking.with_context(at4, 3).select("doc_id", F.col("context_before").alias("before_4"), F.col("context_after").alias("after_4"))


_BREAKS = "length({0}) - length(replace({0}, chr(10), ''))"


# chunk_context above annotates one line a document; this annotates every window of every document
@query(f"""WITH {_WIN}, x AS (SELECT doc_id, start, raw, string_split(text, chr(10)) AS p, {_BREAKS.format("substr(text, 1, start)")} + 1 AS first FROM r WHERE regexp_matches(raw, '\\S')),
y AS (SELECT *, first + {_BREAKS.format("raw")} AS last FROM x)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line, coalesce(array_to_string(p[greatest(1, first - 3):first - 1], chr(10)), '') AS context_before, coalesce(array_to_string(p[last + 1:last + 3], chr(10)), '') AS context_after FROM y""")
def chunk_context_all(spark, d):
    chunks = chunking.sliding_windows(table(spark, d, "documents"), _SIZE, _SIZE - _STEP, "none")
    return chunking.with_context(chunks, 3).select("doc_id", "start", "start_line", "end_line", "context_before", "context_after")


@query(f"""WITH {_WIN} SELECT doc_id, CAST(start AS INTEGER) AS start, substr(sha256(f || ':' || start || ':' || (start + length(raw))), 1, 32) AS chunk_id, f AS file_id FROM (SELECT *, substr(sha256('doc/' || doc_id), 1, 16) AS f FROM r) WHERE regexp_matches(raw, '\\S')""")
def chunk_ids(spark, d):
    rows = chunking.sliding_windows(table(spark, d, "documents"), _SIZE, _SIZE - _STEP, "none")
    rows = rows.withColumn("file_id", ids.file_id(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))))
    return rows.select("doc_id", "start", ids.chunk_id("file_id", F.col("start"), F.col("end")).alias("chunk_id"), "file_id")


@query("SELECT doc_id, sha256('[' || lang || '] [snippet] ' || source || CASE WHEN doc_id % 2 = 0 THEN ' :: d' || doc_id ELSE '' END || chr(10) || text) AS sha FROM documents")
def embedding_text(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.embedding_text(F.col("lang"), F.lit("snippet"), F.col("source"), name, F.col("text")), 256).alias("sha"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, CAST(CASE WHEN regexp_matches(text, '\\S') THEN len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) ELSE 0 END AS INTEGER) AS words, right(text, 128) AS tail FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.token_count("text").alias("tokens"), text.word_count("text").alias("words"), text.overlap_tail("text", 32).alias("tail"))


# stores and statistics

@query("SELECT count(DISTINCT source) AS total_files, count(*) AS total_chunks, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS total_tokens FROM documents")
def index_stats(spark, d):
    chunks = table(spark, d, "documents").select(F.col("source").alias("file_id"), F.col("lang").alias("language"), F.lit("snippet").alias("chunk_type"), text.token_count("text").alias("token_count"))
    return store.index_stats(chunks).select("total_files", "total_chunks", "total_tokens")


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1")
def lang_counts(spark, d):
    chunks = table(spark, d, "documents").select(F.col("source").alias("file_id"), F.col("lang").alias("language"), F.lit("snippet").alias("chunk_type"), F.lit(1).alias("token_count"))
    return store.index_stats(chunks).select(F.explode("by_language").alias("language", "n"))


@query("WITH o AS (SELECT * FROM events WHERE event_id % 3 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 3 = 0), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM o) SELECT user_id, event_id, event_type, value FROM n WHERE r = 1 UNION ALL SELECT user_id, event_id, event_type, value FROM l WHERE r = 1 AND user_id NOT IN (SELECT user_id FROM n)")
def upsert_latest_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    old = store.latest(rows.filter("event_id % 3 <> 0"), "user_id", "event_id")
    return store.upserted(old, rows.filter("event_id % 3 = 0"), "user_id", "event_id")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src0'")
def delete_by_file(spark, d):
    return table(spark, d, "documents").filter(~(F.col("source") == "src0")).select("doc_id", "source")


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_sha256(spark, d):
    # the path tells the document, as the derived columns keep no other column
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("language"), F.lit("utf-8").alias("encoding"), F.col("text").alias("content"), F.octet_length("text").alias("size_bytes"))
    return finish(docs).groupBy(F.col("sha256").alias("sha")).agg(F.min(F.col("path").cast("long")).alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source AS path, doc_id FROM documents n WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.source = n.source AND sha256(o.text) = sha256(n.text))")
def incremental_skip(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), "doc_id")
    return changed(files, files.filter("doc_id % 2 = 0")).select("path", "doc_id")


@query("SELECT page_id, CASE lower(regexp_extract(url || x, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in sorted(REGISTRY.known.items())) + " ELSE 'unknown' END AS language FROM (SELECT page_id, url, ['.py', '.TSX', '.h', '.md', ''][CAST(page_id % 5 AS INTEGER) + 1] AS x FROM pages)")
def lang_detect_ext(spark, d):
    x = F.get(F.array(*map(F.lit, (".py", ".TSX", ".h", ".md", ""))), (F.col("page_id") % 5).cast("int"))
    return table(spark, d, "pages").select("page_id", REGISTRY.detect(F.concat("url", x)).alias("language"))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || ['/build/x.py', '/a.min.js', '/src/b.py', '/node_modules', ''][CAST(page_id % 5 AS INTEGER) + 1] AS path FROM pages) SELECT page_id FROM p WHERE NOT (regexp_full_match(path, '(?s)(.*\\.min\\.js|build/.*|node_modules/.*)') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('build', 'node_modules') OR regexp_full_match(x, '.*\\.min\\.js'))) > 0)")
def ignore_glob(spark, d):
    x = F.get(F.array(*map(F.lit, ("/build/x.py", "/a.min.js", "/src/b.py", "/node_modules", ""))), (F.col("page_id") % 5).cast("int"))
    rows = table(spark, d, "pages").withColumn("path", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), x))
    return rows.filter(~ignored("path", ("*.min.js", "build/**", "node_modules/**"))).select("page_id")


# identifiers and terms

def _split_sql(x: str) -> str:
    return f"[lower(t) FOR t IN string_split_regex(regexp_replace(regexp_replace({x}, '({text._LOW})({text._UP})', '\\1 \\2', 'g'), '({text._UP}+)({text._UP}[a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+') IF len(t) >= 2]"


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_IDENT = "p_type || replace(initcap_name, ' ', '')"
_NAMED = "(SELECT p_partkey, p_type, p_name, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], '') AS pascal FROM part)"


@query(f"SELECT p_partkey, array_to_string({_split_sql('pascal || p_type || chr(95) || p_name')}, ' ') AS words FROM {_NAMED}")
def split_identifier(spark, d):
    part = table(spark, d, "part").withColumn("pascal", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    return part.select("p_partkey", F.array_join(text.split_identifier(F.concat("pascal", "p_type", F.lit("_"), "p_name")), " ").alias("words"))


@query(f"WITH w AS (SELECT p_partkey, list_concat({_split_sql('pascal')}, {_split_sql('p_type || chr(95) || chr(103) || chr(101) || chr(116)')}) AS l FROM {_NAMED}) SELECT p_partkey, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i AND l[i] NOT IN ({_STOPS})], ' ') AS words FROM w")
def noun_tokens(spark, d):
    part = table(spark, d, "part").withColumn("pascal", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    return part.select("p_partkey", F.array_join(text.noun_tokens(F.array("pascal", F.concat("p_type", F.lit("_get"))), True), " ").alias("words"))


@query(f"SELECT doc_id, sha256(array_to_string([t FOR t IN string_split_regex(lower(text), '[^a-z0-9]+') IF len(t) >= 2 AND t NOT IN ({_STOPS})], ' ')) AS keywords FROM documents WHERE text IS NOT NULL")
def keywords(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(F.array_join(text.query_keywords("text"), " "), 256).alias("keywords"))


def _kb(spark, d):
    f = F.struct(F.col("p_brand").alias("file_path"), F.col("p_name").alias("symbol_name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("summary"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    usages = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("raw_name"), name.alias("expanded_name"), F.concat(F.lit("about "), "p_name").alias("definition"), F.array().cast("array<string>").alias("noun_tokens"), f.alias("functionality"))
    return terms.knowledge_base(usages)


@query("SELECT lower(p_name) AS key, arg_min(p_type, p_partkey) AS raw_name, arg_min(CASE WHEN p_partkey % 2 = 0 THEN array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') ELSE p_name END, p_partkey) AS expanded_name, CAST(count(*) AS INTEGER) AS usages FROM part GROUP BY 1")
def term_kb_group(spark, d):
    return _kb(spark, d).select("key", "raw_name", "expanded_name", F.size("functionalities").alias("usages"))


@query("WITH k AS (SELECT lower(p_name) AS key FROM part GROUP BY 1), o AS (SELECT key, len(list_intersect(['red', 'widget', 'bolt'], list_concat(string_split(key, ' '), [key]))) AS overlap FROM k) SELECT key, CAST(overlap AS INTEGER) AS overlap FROM o WHERE overlap > 0")
def term_kb_search(spark, d):
    return terms.search_terms_for(_kb(spark, d), "Is the red widget a bolt for?").select("key", "overlap")


@query("WITH k AS (SELECT lower(p_name) AS key, arg_min(CASE WHEN p_partkey % 2 = 0 THEN array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') ELSE p_name END, p_partkey) AS n, 'about ' || arg_min(p_name, p_partkey) AS def, list(struct_pack(k := p_partkey, s := p_name, f := p_brand, y := p_type) ORDER BY p_partkey)[1:5] AS u FROM part GROUP BY 1) SELECT key, 'Term: ' || n || chr(10) || 'Definition: ' || def || chr(10) || 'Usages:' || chr(10) || array_to_string(['  • ' || x.s || ' (' || x.f || '): ' || x.y FOR x IN u], chr(10)) AS text FROM k")
def term_prompt_text(spark, d):
    return _kb(spark, d).select("key", render.term_prompt().alias("text"))


# packing

_ITEMS = "items AS (SELECT d.doc_id AS id, (coalesce(l.quality, 0) + 0.5)::DOUBLE AS score, CAST(greatest(1, ceil(n_chars / 4.0)) AS BIGINT) AS cost, d.source FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"


def _items(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("id"), (F.coalesce("quality", F.lit(0)) + 0.5).alias("score"), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 4)).cast("long").alias("cost"), "source")


@query(f"""WITH RECURSIVE {_ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY -score / cost, id, cost, score) AS i FROM items WHERE cost <= 8192),
g AS (SELECT source, 0 AS i, 8192::BIGINT AS rest, NULL::BIGINT AS id, NULL::BIGINT AS cost, NULL::DOUBLE AS score FROM (SELECT DISTINCT source FROM o)
UNION ALL SELECT o.source, o.i, CASE WHEN o.cost <= g.rest THEN g.rest - o.cost ELSE g.rest END, CASE WHEN o.cost <= g.rest THEN o.id END, o.cost, o.score FROM g JOIN o ON o.source = g.source AND o.i = g.i + 1)
SELECT source, id, cost, score FROM g WHERE id IS NOT NULL""")
def greedy_pack(spark, d):
    return knapsack.greedy(_items(spark, d).filter("cost <= 8192"), 8192, ["source"]).select("source", "id", "cost", "score")


@query(None)
def dp_pack(spark, d):
    return knapsack.exact(_items(spark, d).filter("cost <= 8192"), 8192, 64, ["source"]).select("source", "id", "score", "cost")


@query(f"""WITH RECURSIVE {_ITEMS}, o AS (SELECT *, row_number() OVER (ORDER BY -score / cost, id, cost, score) AS i FROM items WHERE cost <= 8192),
g AS (SELECT 0 AS i, 8192::BIGINT AS rest, 0::BIGINT AS taken, 0::BIGINT AS n UNION ALL SELECT o.i, CASE WHEN o.cost <= g.rest THEN g.rest - o.cost ELSE g.rest END, CASE WHEN o.cost <= g.rest THEN taken + o.cost ELSE taken END, CASE WHEN o.cost <= g.rest THEN n + 1 ELSE n END FROM g JOIN o ON o.i = g.i + 1)
SELECT max(taken) AS total_tokens, round(max(taken) / 8192.0::DOUBLE, 6) AS utilization, max(n) AS packed, (SELECT count(DISTINCT id) FROM items) - max(n) AS dropped FROM g""")
def packed_totals(spark, d):
    items = _items(spark, d).select("id", "score", "cost")
    return knapsack.totals(knapsack.pack(items, 8192), items, 8192).withColumn("utilization", F.round("utilization", 6))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s) SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM g GROUP BY user_id, s")
def sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("started"), "n")

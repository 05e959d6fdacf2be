"""The graph of a files table: nodes and typed edges, by joins over the extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..extract.run import extract, rows
from ..functions import ids
from ..lineage import settle
from .resolve import enclosing, resolve_bases, resolve_calls, resolve_imports, resolve_injections

_EDGE = {"line": "int", "confidence": "double", "module_string": "string", "imported_names": "array<string>", "alias": "string", "is_relative": "boolean", "field_name": "string", "field_type": "string", "seq": "long"}


def _edges(df: DataFrame, rel: str, source: str, target: str, **props) -> DataFrame:
    cols = [F.lit(None).cast(t).alias(c) if c not in props else props[c].cast(t).alias(c) for c, t in _EDGE.items()]
    return df.select(ids.edge_id(F.lit(rel), F.col(source), F.col(target)).alias("id"), F.lit(rel).alias("rel_type"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), *cols)


def folders(files: DataFrame, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """(directories, PART_OF edges): every folder above a file; with `parity`, only its own and the next."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    chain = files.filter(depth > 0).select("path", "file_id", F.transform(F.sequence(depth, F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("up"))
    if parity:
        chain = chain.withColumn("up", F.slice("up", 1, 2))
    every = chain.select(F.explode("up").alias("path")).distinct()
    directories = every.select(ids.digest("path").alias("id"), "path")
    own = chain.select(F.col("file_id").alias("s"), ids.digest(F.get("up", F.lit(0))).alias("t"))
    pairs = chain.select(F.explode(F.arrays_zip(F.slice("up", 1, F.size("up") - 1).alias("a"), F.slice("up", F.lit(2), F.size("up")).alias("b"))).alias("p")).filter("p.a is not null and p.b is not null").distinct()
    above = pairs.select(ids.digest(F.col("p.a")).alias("s"), ids.digest(F.col("p.b")).alias("t"))
    return directories, _edges(own.union(above), "PART_OF", "s", "t")


def build_graph(files: DataFrame, extracted: DataFrame | None = None, self_loops: bool = False, parity_dirs: bool = False) -> dict[str, DataFrame]:
    """files, directories, symbols, edges_raw, edges, external_imports, failures of a files table.

    edges_raw keeps repeated calls, edges has the last of each id and how often it came. Imports that resolve to no
    file are in external_imports; `self_loops` adds them to the edges as loops. The extraction is settled, as all parts
    read it.
    """
    extracted = settle(extract(files) if extracted is None else extracted)
    file_nodes = files.select(F.col("file_id").alias("id"), "path", "language", "sha256")
    raw = rows(extracted, "symbols").withColumn("qualified_name", ids.qualified_name(F.col("path"), F.col("parent_name"), F.col("name")))
    raw = raw.withColumn("id", ids.symbol_id("file_id", "qualified_name"))
    raw = raw.withColumn("seq", F.col("pos").cast("long"))
    symbols = raw.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).filter("_n = 1").select("id", "name", "qualified_name", "kind", "file_id", F.col("path").alias("file_path"), "start_line", "end_line", "parent_name", "decorators", "seq")
    # the first of several files is by path, so the order within everything is (path parts, seq)
    ordered = symbols.withColumn("seq", F.struct(F.split("file_path", "/"), "start_line", "seq"))
    last = symbols.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", "name").orderBy(F.desc("seq")))).filter("_n = 1").drop("_n")

    imports = rows(extracted, "imports").withColumn("import_id", ids.digest("file_id", F.col("pos").cast("string")))
    resolved = resolve_imports(imports, files.select("file_id", "path"))
    linked = resolved.filter("target is not null and target <> file_id").select("file_id", "target").distinct()
    props = dict(line=F.col("line"), module_string=F.col("module"), imported_names=F.col("names"), alias=F.col("alias"), is_relative=F.col("is_relative"), seq=F.col("pos"))
    parts = [_edges(raw.select("file_id", "id", "pos"), "DEFINES", "file_id", "id", seq=F.col("pos"))]
    owner = last.select("file_id", F.col("name").alias("parent_name"), F.col("id").alias("owner_id"))
    parts.append(_edges(symbols.join(owner, ["file_id", "parent_name"]).filter("owner_id <> id"), "CONTAINS", "owner_id", "id"))
    directories, part_of = folders(files, parity_dirs)
    parts.append(part_of)
    parts.append(_edges(resolved.filter("target is not null"), "IMPORTS", "file_id", "target", **props))
    if self_loops:
        parts.append(_edges(resolved.filter("target is null"), "IMPORTS", "file_id", "file_id", **props))

    calls = rows(extracted, "calls").filter("callee <> ''").withColumn("call_id", ids.digest("file_id", F.col("pos").cast("string")))
    spans = symbols.select("file_id", F.col("id").alias("caller_id"), "start_line", "end_line")
    placed = enclosing(calls, spans, "file_id", "line", "call_id", "caller_id").filter("caller_id is not null").select("call_id", "file_id", "caller_id", "callee", "line", "pos")
    called = resolve_calls(placed, symbols, linked).filter("callee_id is not null and tier <> 'self'")
    parts.append(_edges(called, "CALLS", "caller_id", "callee_id", line=F.col("line"), confidence=F.col("confidence"), seq=F.col("pos")))

    named = last.select("file_id", F.col("name").alias("child"), F.col("id").alias("child_id"))
    bases = rows(extracted, "bases").join(named, ["file_id", "child"]).select("child_id", "file_id", "base")
    parts.append(_edges(resolve_bases(bases, symbols, linked), "INHERITS_FROM", "child_id", "parent_id"))
    wanted = rows(extracted, "injections").join(named.withColumnsRenamed({"child": "class_name", "child_id": "class_id"}), ["file_id", "class_name"]).select("class_id", "file_id", "type_name", "field_name")
    injected = resolve_injections(wanted, ordered, linked)
    parts.append(_edges(injected, "INJECTS", "class_id", "injected_id", field_name=F.col("field_name"), field_type=F.col("type_name")))

    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    last_edge = Window.partitionBy("id").orderBy(F.desc(F.coalesce("line", F.lit(0))), F.desc(F.coalesce("seq", F.lit(0))))
    edges = everything.withColumn("count", F.count("*").over(Window.partitionBy("id"))).withColumn("_n", F.row_number().over(last_edge)).filter("_n = 1").drop("_n")
    return {
        "files": file_nodes,
        "directories": directories,
        "symbols": symbols,
        "edges_raw": everything,
        "edges": edges,
        "external_imports": resolved.filter("target is null").select("file_id", "path", "language", "module", "names", "line"),
        "failures": extracted.filter(F.size("errors") > 0).select("file_id", "path", "errors"),
    }

"""Resolution of imports, calls, bases and injections by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTENSIONS = {
    language: tuple(endings.split())
    for language, endings in {"python": ".py /__init__.py .pyi", "javascript": ".js .jsx .ts .tsx /index.js /index.ts /index.jsx /index.tsx", "rust": ".rs /mod.rs", "java": ".java"}.items()
}
EXTENSIONS["typescript"] = EXTENSIONS["javascript"]


def joined(*parts: Column) -> Column:
    """Path parts joined by slashes, empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.length(p) > 0), "/")


def normalized(path: Column) -> Column:
    """A relative path with . and .. worked out; null where it leaves the root."""
    step = lambda s, p: (
        F.when(s.isNull() | (p == "") | (p == "."), s).when((p == "..") & (F.size(s) == 0), F.lit(None)).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_candidates(imports: DataFrame) -> DataFrame:
    """imports with `bases`: paths without extension that the module may mean, best first.

    imports has import_id, path (of the importing file), module and language. Python counts leading dots and then tries
    ever shorter prefixes; JavaScript and TypeScript resolve relative modules only; Rust knows self, super and crate;
    Java turns dots to slashes.
    """
    module, path = F.col("module"), F.col("path")
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    up = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - dots + 1, F.lit(0))), "/")
    relative = F.when(dots - 1 <= F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/"))), F.array(joined(up, rest)))
    names = F.split(rest, "/")
    shorter = F.transform(F.sequence(F.size(names), F.lit(1)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))
    python = F.when(dots > 0, relative).otherwise(shorter)
    script = F.when(module.startswith("."), F.array(normalized(joined(folder, module))))
    inner = F.regexp_replace(module, "::", "/")
    rust_base = (
        F.when(module.rlike("^(std|core)(::|$)"), None)
        .when(module.startswith("self::"), joined(folder, F.regexp_replace(inner, "^self/", "")))
        .when(module.startswith("super::"), joined(F.regexp_replace(folder, "/?[^/]*$", ""), F.regexp_replace(inner, "^super/", "")))
        .when(module.startswith("crate::"), joined(F.lit("src"), F.regexp_replace(inner, "^crate/", "")))
        .otherwise(inner)
    )
    java = F.array(F.regexp_replace(module, r"\.", "/"))
    language = F.col("language")
    bases = F.when(language == "python", python).when(language.isin("javascript", "typescript"), script).when(language == "rust", F.array_compact(F.array(rust_base))).when(language == "java", java)
    return imports.withColumn("bases", bases)


def unique_suffixes(files: DataFrame) -> DataFrame:
    """(suffix, file_id) of every trailing sub-path without extension that only one file has."""
    parts = F.split(F.regexp_replace("path", r"\.[^./]+$", ""), "/")
    rows = files.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    return rows.groupBy("suffix").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id")).filter("n = 1").drop("n")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with target, the file_id that a module means, or null.

    Every candidate path with every extension of its language is one row to an equi-join; the best rank wins. What is
    left, and absolute, is looked up among the suffixes that only one file has (Python and Java).
    """
    probes = F.create_map(*[c for lang, ext in EXTENSIONS.items() for c in (F.lit(lang), F.array(F.lit(""), *map(F.lit, ext)))])
    based = import_candidates(imports)
    rows = based.select("import_id", F.posexplode("bases").alias("b", "base"), probes[F.col("language")].alias("ext"))
    rows = rows.select("import_id", "b", "base", F.posexplode("ext").alias("e", "x")).select("import_id", F.struct("b", "e").alias("rank"), F.concat("base", "x").alias("path")).filter("path <> ''")
    direct = rows.join(files.select("path", "file_id"), "path").groupBy("import_id").agg(F.min_by("file_id", "rank").alias("direct"))
    absolute = imports.filter(F.col("language").isin("python", "java") & ~F.col("module").startswith(".")).select("import_id", F.regexp_replace("module", r"\.", "/").alias("suffix"))
    suffix = absolute.join(unique_suffixes(files), "suffix").select("import_id", F.col("file_id").alias("by_suffix"))
    return imports.join(direct, "import_id", "left").join(suffix, "import_id", "left").withColumn("target", F.coalesce("direct", "by_suffix")).drop("direct", "by_suffix")


def enclosing(points: DataFrame, spans: DataFrame, group: str, at: str, key: str, span_id: str = "span_id", first: str = "start_line", last: str = "end_line") -> DataFrame:
    """points with the id of the smallest span of their group that holds them; ties go to the earlier start, then the smaller id.

    An equi-join on the group with a range left over, and the best span by a partial aggregate rather than a window.
    """
    inside = points.join(spans.select(group, span_id, first, last), group).filter(F.col(at).between(F.col(first), F.col(last)))
    best = inside.groupBy(key).agg(F.min(F.struct((F.col(last) - F.col(first)).alias("size"), F.col(first).alias("start"), F.col(span_id).alias("id"))).alias("best"))
    return points.join(best, key, "left").withColumn(span_id, F.col("best.id")).drop("best")


def last_definition(symbols: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """The last of the symbols that share the columns `by`."""
    return symbols.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(seq)))).filter("_n = 1").drop("_n")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """calls with tier, callee_id and confidence.

    calls: call_id, file_id, caller_id, callee; symbols: id, file_id, name, seq; imports: file_id, target. A name of the
    same file wins (0.85); then one found in exactly one imported file (0.90; in several, the call is dropped); then
    one that is unique everywhere (0.50). Self calls resolve to the caller and are marked. Tiers are three equi-joins.
    """
    named = last_definition(symbols, ["file_id", "name"])
    wanted = calls.select("file_id", "callee").distinct()
    own = named.select("file_id", F.col("name").alias("callee"), F.col("id").alias("own_id"))
    linked = imports.select("file_id", F.col("target").alias("far_file")).filter("file_id <> far_file").distinct()
    far = named.select(F.col("file_id").alias("far_file"), F.col("name").alias("callee"), F.col("id").alias("far_id"))
    imported = wanted.join(linked, "file_id").join(far, ["far_file", "callee"]).groupBy("file_id", "callee").agg(F.count("*").alias("n_imported"), F.min("far_id").alias("imported_id"))
    everywhere = symbols.groupBy(F.col("name").alias("callee")).agg(F.count_distinct("id").alias("n_global"), F.min("id").alias("global_id"))
    rows = calls.join(own, ["file_id", "callee"], "left").join(imported, ["file_id", "callee"], "left").join(everywhere, "callee", "left")
    tier = (
        F.when(F.col("own_id").isNotNull(), F.lit("same_file"))
        .when(F.col("n_imported") == 1, F.lit("imported"))
        .when(F.col("n_imported") > 1, F.lit("ambiguous_imported"))
        .when(F.col("n_global") == 1, F.lit("global"))
        .when(F.col("n_global") > 1, F.lit("ambiguous_global"))
        .otherwise(F.lit("unknown"))
    )
    rows = rows.withColumn("tier", tier)
    rows = rows.withColumn("callee_id", F.when(F.col("tier") == "same_file", F.col("own_id")).when(F.col("tier") == "imported", F.col("imported_id")).when(F.col("tier") == "global", F.col("global_id")))
    rows = rows.withColumn("confidence", F.when(F.col("callee_id").isNull(), None).when(F.col("tier") == "same_file", 0.85).when(F.col("tier") == "imported", 0.90).otherwise(0.50))
    rows = rows.withColumn("tier", F.when(F.col("callee_id") == F.col("caller_id"), F.lit("self")).otherwise(F.col("tier")))
    return rows.select(*calls.columns, "tier", "callee_id", "confidence")


def resolve_bases(bases: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(child_id, parent_id): a base in the same file, else the first in an imported file, else the first anywhere. bases: child_id, file_id, base.

    A child is no base of its own, so two symbols of a name are enough of a file, of the imported files and of all files.
    They are found before the bases are joined: a name of many symbols does not meet all of its uses.
    """
    names = symbols.filter("id is not null").groupBy(F.col("file_id").alias("far_file"), F.col("name").alias("base"), F.col("id").alias("parent_id")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))

    def two(rows: DataFrame, by: list[str], near: int, at: Column) -> DataFrame:
        rows = rows.withColumn("rank", F.struct(F.lit(near).alias("near"), at.alias("at"), "parent_id"))
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).filter("_n <= 2").drop("_n")

    # in the same file the last definition counts, elsewhere the first
    own = two(names, ["far_file", "base"], 0, -F.col("last")).select(F.col("far_file").alias("file_id"), "base", "rank")
    heads = two(names, ["far_file", "base"], 1, F.col("first"))
    linked = imports.select("file_id", F.col("target").alias("far_file")).filter("file_id <> far_file").distinct()
    imported = bases.select("file_id", "base").distinct().join(linked, "file_id").join(heads.drop("rank"), ["far_file", "base"])
    imported = two(imported, ["file_id", "base"], 1, F.col("first")).select("file_id", "base", "rank")
    anywhere = two(heads, ["base"], 2, F.col("first")).select("base", "rank")
    found = bases.join(own.unionByName(imported), ["file_id", "base"]).select("child_id", "base", "rank").unionByName(bases.join(anywhere, "base").select("child_id", "base", "rank"))
    best = found.filter("child_id <> rank.parent_id").groupBy("child_id", "base").agg(F.min("rank").alias("rank"))
    return best.select("child_id", F.col("rank.parent_id").alias("parent_id")).distinct()


def resolve_injections(wanted: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(class_id, injected_id, field_name, type_name): one imported match, or of several the first class, else a name unique everywhere. wanted: class_id, file_id, type_name, field_name."""
    names = symbols.select(F.col("file_id").alias("far_file"), F.col("name").alias("type_name"), F.col("id").alias("far_id"), F.col("kind").alias("far_kind"), F.col("seq").alias("far_seq"))
    linked = imports.select("file_id", F.col("target").alias("far_file")).distinct()
    # one symbol for each name of a file, then one for each name that a file wants, before the classes are joined
    heads = names.groupBy("far_file", "type_name").agg(F.min(F.struct((F.col("far_kind") != "class").alias("other"), "far_seq", "far_id")).alias("best"))
    heads = wanted.select("file_id", "type_name").distinct().join(linked, "file_id").join(heads, ["far_file", "type_name"]).groupBy("file_id", "type_name").agg(F.min("best").alias("best"))
    inside = wanted.join(heads, ["file_id", "type_name"]).groupBy("class_id", "type_name", "field_name").agg(F.min("best")["far_id"].alias("imported_id"))
    everywhere = names.groupBy("type_name").agg(F.count("*").alias("n"), F.min("far_id").alias("global_id")).filter("n = 1").drop("n")
    rows = wanted.join(inside, ["class_id", "type_name", "field_name"], "left").join(everywhere, "type_name", "left")
    return rows.withColumn("injected_id", F.coalesce("imported_id", "global_id")).filter("injected_id is not null and injected_id <> class_id").select("class_id", "injected_id", "field_name", "type_name")

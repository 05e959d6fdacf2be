"""Chunkers: sliding windows, token-bounded lines, and syntax nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

#: Syntax node types and the chunk type they become; anything else is a snippet.
NODE_TYPES = {
    "function": "function", "async_function": "function", "arrow": "function", "fn": "function", "method": "method", "constructor": "method",
    "class": "class", "struct": "class", "impl": "class", "type": "class", "interface": "interface", "trait": "interface", "enum": "enum", "mod": "module",
}


def sliding_windows(docs: DataFrame, size: int = 2000, overlap: int = 200, snap: str = "end", least_words: int = 0, column: str = "text") -> DataFrame:
    """docs with start, end (characters), start_line, end_line, start_byte, end_byte and chunk.

    Windows step by size - overlap. snap 'none' cuts at size; 'end' moves a window's end back to the last line end in
    it, as long as that is not its first character, while the step stays fixed, so text may fall between two windows;
    'advance' closes that gap by reaching on to the next window's start. No Python is involved.
    """
    if snap not in ("none", "end", "advance"):
        raise ValueError(f"no snap {snap}")
    step = max(1, size - overlap)
    x = F.col(column)
    rows = docs.withColumn("_n", F.length(x)).filter(x.rlike(r"\S"))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step)))).filter((F.col("start") == 0) | (F.col("start") - step + size < F.col("_n")))
    rows = rows.withColumn("_raw", F.substring(x, F.col("start") + 1, F.lit(size)))
    if snap == "none":
        rows = rows.withColumn("chunk", F.col("_raw"))
    else:
        at = F.length("_raw") - F.locate("\n", F.reverse("_raw")) + 1  # characters up to and with the last line end
        snapped = (F.col("start") + size < F.col("_n")) & (F.locate("\n", F.reverse("_raw")) > 0) & (at > 1)
        keep = at if snap == "end" else F.greatest(at, F.lit(min(step, size)))
        rows = rows.withColumn("chunk", F.when(snapped, F.substring(F.col("_raw"), F.lit(1), keep)).otherwise(F.col("_raw")))
    before = F.substring(x, F.lit(1), F.col("start"))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = rows.withColumns({"end": F.col("start") + F.length("chunk"), "start_line": lines(before) + 1, "start_byte": F.octet_length(before)})
    rows = rows.withColumns({"end_line": F.col("start_line") + lines(F.col("chunk")), "end_byte": F.col("start_byte") + F.octet_length("chunk")})
    rows = rows.filter(F.col("chunk").rlike(r"\S"))
    if least_words:
        rows = rows.filter(text.word_count("chunk") >= least_words)
    return rows.drop("_n", "_raw")


_PACKED = "array<struct<first:int,last:int,body:string>>"


def token_chunks(docs: DataFrame, size: int = 512, overlap: int = 64, least_words: int = 0, column: str = "text") -> DataFrame:
    """docs with chunk_no, start_line, end_line and chunk: lines packed greedily up to `size` estimated tokens.

    A line that would overflow the buffer closes it; a line that is too long alone is emitted whole. A chunk after the
    first is prefixed with the last `overlap` tokens of the buffer before it, which count neither as its lines nor in
    its size. The buffer resets, so this is an aggregate over a document's lines, not a window.
    """
    x = F.col(column)
    pieces = F.split(x, "(?<=\n)")
    lines = F.filter(pieces, lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast(_PACKED).alias("done"), F.lit(1).alias("first"), F.lit(0).alias("line"), F.lit("").alias("body"), F.lit(0).alias("used"))

    def step(s: Column, line: Column) -> Column:
        cost = text.token_count(line)
        full = (s["used"] > 0) & (s["used"] + cost > size)
        closed = F.struct(s["first"].alias("first"), s["line"].alias("last"), s["body"].alias("body"))
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(closed))).otherwise(s["done"]).cast(_PACKED).alias("done"),
            F.when(full, s["line"] + 1).otherwise(s["first"]).alias("first"),
            (s["line"] + 1).alias("line"),
            F.when(full, line).otherwise(F.concat(s["body"], line)).alias("body"),
            F.when(full, cost).otherwise(s["used"] + cost).alias("used"),
        )

    def finish(s: Column) -> Column:
        return F.when(s["used"] > 0, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["line"].alias("last"), s["body"].alias("body"))))).otherwise(s["done"]).cast(_PACKED)

    rows = docs.filter(x.rlike(r"\S")).withColumn("_all", F.aggregate(lines, start, step, finish))
    rows = rows.select(*docs.columns, "_all", F.posexplode("_all").alias("chunk_no", "_one"))
    tail = F.when(F.col("chunk_no") > 0, text.overlap_tail(F.get("_all", F.col("chunk_no") - 1)["body"], overlap)).otherwise(F.lit(""))
    rows = rows.select(*docs.columns, "chunk_no", F.col("_one.first").alias("start_line"), F.col("_one.last").alias("end_line"), F.concat(tail, F.col("_one.body")).alias("chunk")).filter(F.col("chunk").rlike(r"\S"))
    return rows.filter(text.word_count("chunk") >= least_words) if least_words else rows


def with_context(chunks: DataFrame, lines: int = 3, column: str = "text") -> DataFrame:
    """chunks with the k lines before and after them, as context_before and context_after."""
    every = F.split(column, "\n")
    first = F.greatest(F.lit(1), F.col("start_line") - lines)
    return chunks.withColumns({
        "context_before": F.array_join(F.slice(every, first, F.col("start_line") - first), "\n"),
        "context_after": F.array_join(F.slice(every, F.col("end_line") + 1, F.lit(lines)), "\n"),
    })


def node_chunks(files: DataFrame, nodes: DataFrame, least_words: int = 0, size: int = 512, overlap: int = 64, split_oversize: bool = False) -> DataFrame:
    """Chunks of syntax nodes (file_id, type, name, parent, start_byte, end_byte, start_line, end_line), cut from the files' bytes.

    A file without nodes goes to the token chunker whole; with `split_oversize`, so does a node above `size` tokens.
    """
    kinds = F.create_map(*[F.lit(v) for kv in NODE_TYPES.items() for v in kv])
    raw = F.encode(F.col("content"), "UTF-8")
    cut = files.join(nodes, "file_id").withColumn("chunk", F.decode(F.substring(raw, F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")), "UTF-8"))
    kind = F.when((F.col("type") == "function") & F.col("parent").isNotNull(), "method").otherwise(F.coalesce(kinds[F.col("type")], F.lit("snippet")))
    cut = cut.withColumn("chunk_type", kind)
    whole = ["file_id", "path", "language", "chunk_type", "name", "start_line", "end_line", "chunk"]
    oversize = text.token_count("chunk") > size
    rest = files.join(nodes.select("file_id").distinct(), "file_id", "left_anti")
    packed = token_chunks(rest, size, overlap, column="content").select("file_id", "path", "language", F.lit("snippet").alias("chunk_type"), F.lit(None).cast("string").alias("name"), "start_line", "end_line", "chunk")
    out = cut.filter(~oversize).select(*whole) if split_oversize else cut.select(*whole)
    if split_oversize:
        big = token_chunks(cut.filter(oversize).select("file_id", "path", "language", "chunk_type", "name", F.col("start_line").alias("from_line"), F.col("chunk").alias("whole")), size, overlap, column="whole")
        out = out.unionByName(big.select("file_id", "path", "language", "chunk_type", "name", (F.col("from_line") + F.col("start_line") - 1).alias("start_line"), (F.col("from_line") + F.col("end_line") - 1).alias("end_line"), "chunk"))
    out = out.unionByName(packed).filter(F.col("chunk").rlike(r"\S"))
    return (out.filter(text.word_count("chunk") >= least_words) if least_words else out).withColumn("token_count", text.token_count("chunk")).withColumn("chunk_id", ids.chunk_id("file_id", F.col("start_line"), F.col("end_line")))


CHUNKERS = {"token": token_chunks, "sliding_window": sliding_windows}


def chunker(strategy: str):
    """The chunker of a strategy; 'ast', 'semantic' and unknown names mean syntax nodes."""
    return CHUNKERS.get(strategy, node_chunks)

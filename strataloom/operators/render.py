"""Texts and diagrams made from contexts, impacts, concerns, terms and packings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _listed(items: Column, field: str | None, most: int | None = None) -> Column:
    cut = F.slice(items, 1, most) if most else items
    return F.array_join(F.transform(cut, lambda x: x[field]) if field else cut, ", ")


def _line(label: str, items: Column, field: str | None, most: int | None = None) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), _listed(items, field, most)))


def _style(name: str, fill: str, stroke: str, color: str) -> Column:
    return F.lit(f"    classDef {name} fill:#{fill},stroke:#{stroke},color:#{color}")


def context_text() -> Column:
    """A symbol context row as labelled lines; empty parts have no line."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Symbol: "), "qualified_name", F.lit(" ["), "kind", F.lit("]")),
        F.concat(F.lit("File: "), "file_path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("–"), F.col("end_line").cast("string"), F.lit(")")),
        F.when(F.col("parent_class").isNotNull(), F.concat(F.lit("Member of class: "), F.col("parent_class.qualified_name"))),
        _line("Inherits from", F.col("inherits_from"), "name"),
        _line("Subclasses", F.col("subclasses"), "name"),
        _line("Calls", F.col("callees"), "name", 10),
        _line("Called by", F.col("callers"), "name", 10),
        _line("Methods", F.col("methods"), "name", 10),
        _line("File imports", F.col("file_imports"), None, 5),
        _line("Decorators", F.coalesce("decorators", F.array().cast("array<string>")), None),
    )


def label(symbol) -> Column:
    name, kind = (symbol["name"], symbol["kind"]) if not isinstance(symbol, tuple) else symbol
    return F.replace(F.concat(name, F.lit(" ["), kind, F.lit("]")), F.lit('"'), F.lit("'"))


def _nodes(items: Column, prefix: str, most: int, arrow: str, inward: bool, hub: str, skip: Column | None = None) -> Column:
    def node(x: Column, i: Column) -> Column:
        name = F.concat(F.lit(prefix), i.cast("string"))
        link = F.concat(name, F.lit(f" {arrow} {hub}")) if inward else F.concat(F.lit(f"{hub} {arrow} "), name)
        drawn = F.concat(F.lit("    "), name, F.lit('["'), label(x), F.lit('"]\n    '), link)
        return drawn if skip is None else F.when(F.array_contains(skip, x), F.lit(None)).otherwise(drawn)

    return F.array_compact(F.transform(F.slice(items, 1, most), node))


def context_mermaid() -> Column:
    none = F.array().cast("array<string>")
    parent = F.when(F.col("parent_class").isNotNull(), F.array(F.concat(F.lit('    parent["'), label(F.col("parent_class")), F.lit('"]\n    parent -->|contains| focal')))).otherwise(none)
    lines = F.concat(
        F.array(F.lit("flowchart TD"), F.concat(F.lit('    focal["'), label((F.col("name"), F.col("kind"))), F.lit('"]'))),
        _nodes(F.col("callers"), "caller", 8, "-->|calls|", True, "focal"),
        _nodes(F.col("callees"), "callee", 8, "-->|calls|", False, "focal"),
        parent,
        _nodes(F.col("inherits_from"), "base", 4, "-->|inherits|", False, "focal"),
        _nodes(F.col("subclasses"), "sub", 4, "-->|inherits|", True, "focal"),
    )
    return F.array_join(lines, "\n")


def impact_mermaid(direct: str = "direct_callers", transitive: str = "transitive_callers", subclasses: str = "subclasses") -> Column:
    """The cap on transitive callers counts the direct ones among them, which are not drawn twice."""
    lines = F.concat(
        F.array(F.lit("flowchart TD"), F.concat(F.lit('    target["◆ '), label((F.col("name"), F.col("kind"))), F.lit('  ← CHANGED"]:::changed'))),
        _nodes(F.col(direct), "dc", 12, "-->|calls|", True, "target"),
        _nodes(F.col(transitive), "tc", 12, "-.->|transitive|", True, "target", F.col(direct)),
        _nodes(F.col(subclasses), "sub", 6, "-->|inherits|", True, "target"),
        F.array(_style("changed", "f96", "c33", "000")),
    )
    return F.array_join(lines, "\n")


def concern_block(name="name", description="description", symbols="symbols") -> Column:
    """symbols: array of (qualified_name, file_path, start_line)."""
    each = F.transform(F.slice(_col(symbols), 1, 8), lambda s: F.concat(F.lit("    • "), s["qualified_name"], F.lit("  ("), s["file_path"], F.lit(":"), s["start_line"].cast("string"), F.lit(")")))
    head = F.array(F.concat(F.lit("Concern: "), _col(name)), F.concat(F.lit("  "), _col(description)), F.concat(F.lit("  Relevant code ("), F.size(_col(symbols)).cast("string"), F.lit(" symbols):")))
    return F.array_join(F.concat(head, each), "\n")


def concern_mermaid(name="name", symbols="symbols") -> Column:
    each = F.transform(F.slice(_col(symbols), 1, 10), lambda s, i: F.concat(F.lit("    _sym_"), i.cast("string"), F.lit('["'), label(s), F.lit('"]\n    _title --- _sym_'), i.cast("string")))
    head = F.array(F.lit("flowchart TD"), F.concat(F.lit('    _title["'), F.replace(_col(name), F.lit('"'), F.lit("'")), F.lit('"]:::concern')))
    return F.array_join(F.concat(head, each, F.array(_style("concern", "4a9", "063", "fff"))), "\n")


def term_prompt(usages: int = 5) -> Column:
    """A knowledge-base row for a prompt."""
    lines = F.transform(F.slice("functionalities", 1, usages), lambda f: F.concat(F.lit("  • "), f["symbol_name"], F.lit(" ("), f["file_path"], F.lit("): "), f["summary"]))
    head = F.array(F.concat(F.lit("Term: "), "expanded_name"), F.concat(F.lit("Definition: "), "definition"))
    return F.array_join(F.when(F.size("functionalities") > 0, F.concat(head, F.array(F.lit("Usages:")), lines)).otherwise(head), "\n")


def term_embedding_text() -> Column:
    return F.concat(F.lit("Term: "), "expanded_name", F.lit("\nDefinition: "), "definition", F.lit("\nIn "), "symbol_name", F.lit(" ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("): "), "summary")


def term_line() -> Column:
    return F.concat(F.lit("  ["), "kind", F.lit("] "), "qualified_name", F.lit("  re: "), "expanded_name", F.lit(" — "), "summary")


def term_concern_text() -> Column:
    return F.concat("symbol_name", F.lit(" ("), "file_path", F.lit(") | "), "expanded_name", F.lit(": "), "summary")


def embedding_prefix() -> Column:
    return F.concat("expanded_name", F.lit(": "), "definition")


def packed_line() -> Column:
    """A packed symbol's line in a context window."""
    return F.concat(F.lit("  ["), "kind", F.lit("] "), "qualified_name", F.lit("  "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("  (score="), F.format_string("%.3f", "score"), F.lit(")"))


def _rule(title: str) -> str:
    return f"=== {title} ==="


def packed_text(symbols: int, tokens: int, lines: list[str], concerns: list[str] = ()) -> str:
    """A packing for a prompt: concerns, as hints, above the window's lines."""
    window = "\n".join([_rule(f"Context window: {symbols} symbols ({tokens} est. tokens)"), *lines])
    if not concerns:
        return window
    hints = [_rule("Inferred concerns (use as guidance, not ground truth)"), "", *[x for c in concerns for x in (c, "")], "They were inferred and may miss parts; look further where needed.", ""]
    return "\n".join([*hints, window])


def packed_summary(symbols: int, tokens: int, budget: int, dropped: int, strategy: str) -> str:
    return f"PackedContext: {symbols} symbols, {tokens}/{budget} tokens ({tokens / budget:.0%} utilization), {dropped} dropped [{strategy}]"

"""python -m strataloom.cli: index, search, stats and graph commands; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from .api import Engine, NotFound
from .operators.search import SearchQuery
from .service import serve
from .session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataloom")
    p.add_argument("--home", default="index", help="folder of the stores")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("root")
    index.add_argument("--clear", action="store_true")
    index.add_argument("--metadata", action="append", default=[], metavar="KEY=VALUE")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--top-k", type=int, default=10)
    find.add_argument("--language")
    find.add_argument("--path-prefix")
    find.add_argument("--min-score", type=float, default=0.0)
    find.add_argument("--rerank", action="store_true")
    sub.add_parser("stats")
    sub.add_parser("serve")
    graph = sub.add_parser("graph").add_subparsers(dest="graph_command", required=True)
    build = graph.add_parser("index")
    build.add_argument("root")
    build.add_argument("--clear", action="store_true")
    for name in ("callers", "callees", "context", "impact"):
        c = graph.add_parser(name)
        c.add_argument("symbol")
        c.add_argument("--depth", type=int, default=1)
    graph.add_parser("stats")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    engine = Engine(spark or local_session(), a.home)
    show = lambda df: [print(line) for line in df.toJSON().collect()]
    try:
        if a.command == "index":
            print(json.dumps(engine.index_directory(a.root, a.clear, dict(m.split("=", 1) for m in a.metadata) or None)))
        elif a.command == "search":
            show(engine.search(SearchQuery(a.query, a.top_k, a.language, (), a.path_prefix, a.min_score), a.rerank).drop("embedding"))
        elif a.command == "stats":
            show(engine.vectors.stats())
        elif a.command == "serve":
            serve(engine).serve_forever()
        elif a.graph_command == "index":
            print(json.dumps(engine.index_graph(a.root, a.clear)))
        elif a.graph_command in ("callers", "callees"):
            show(getattr(engine, a.graph_command)(a.symbol, a.depth))
        elif a.graph_command == "context":
            print(engine.context_text(a.symbol))
        elif a.graph_command == "impact":
            show(engine.impact(a.symbol)["callers"])
        else:
            show(engine.graph.stats())
    except NotFound as e:
        print(json.dumps({"error": f"no symbol {e}"}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

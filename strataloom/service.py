"""The engine over HTTP, with the standard library's server: JSON in, JSON out, an optional bearer token."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import DataFrame

from .api import Engine, NotFound
from .operators.search import SearchQuery
from .sources.settings import ApiSettings

log = logging.getLogger(__name__)
VERSION = "0.1"
#: Routes that need no token.
PUBLIC = {"/health", "/ping"}
#: What answers are ordered by, as far as they have it, so that pages follow each other.
ORDER = ("rank", "depth", "id", "chunk_id", "src", "path", "file_path", "start_line")


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def listed(df: DataFrame) -> list[dict]:
    """All rows, in the order of ORDER, a partition at a time."""
    rows = df.drop("embedding")
    keys = [c for c in ORDER if c in rows.columns]
    return [json.loads(r) for r in (rows.orderBy(*keys) if keys else rows).toJSON().toLocalIterator()]


def paged(name: str, df: DataFrame, body: dict) -> dict:
    """Rows under `name`, and how many there are in all. Without `limit` an answer holds every row from `offset` on."""
    offset, limit = int(body.get("offset", 0)), body.get("limit")
    if offset < 0 or (limit is not None and int(limit) < 0):
        raise Refused(422, "offset and limit are not negative")
    if not offset and limit is None:
        found = listed(df)
        return {name: found, "total": len(found)}
    keys = [c for c in ORDER if c in df.columns] or df.columns[:1]
    page = df.orderBy(*keys).offset(offset)
    return {name: listed(page.limit(int(limit)) if limit is not None else page), "total": df.count(), "offset": offset}


def search_query(body: dict) -> SearchQuery:
    known = {f.name for f in fields(SearchQuery)}
    try:
        return SearchQuery(**{k: tuple(v) if k == "chunk_types" else v for k, v in body.items() if k in known})
    except ValueError as e:
        raise Refused(422, str(e)) from e


def folder(body: dict) -> str:
    path = body.get("path", "")
    if not path or not Path(path).is_dir():
        raise Refused(404, f"no directory {path!r}")
    return path


def wanted(body: dict) -> str:
    name = body.get("symbol_id") or body.get("name")
    if not name:
        raise Refused(422, "symbol_id or name is needed")
    return name


def routes(engine: Engine, api: ApiSettings) -> dict[tuple[str, str], Callable[[dict], object]]:
    """(method, path) to a function of the request's body."""

    def graph(f: Callable[[dict], object]) -> Callable[[dict], object]:
        def guarded(body: dict) -> object:
            if not engine.settings.graph.enabled:
                raise Refused(503, "the graph is not enabled")
            return f(body)

        return guarded

    def search(body: dict, rerank: bool) -> dict:
        start, q = time.time(), search_query(body)
        results = listed(engine.search(q, rerank))
        return {"query": q.query, "results": results, "total": len(results), "latency_ms": round(1000 * (time.time() - start), 1)}

    def impact(body: dict) -> dict:
        parts = engine.impact(wanted(body), float(body.get("min_confidence", 0)))
        pages = {k: paged(k, df, body) for k, df in parts.items()}
        return {k: p[k] for k, p in pages.items()} | {"totals": {k: p["total"] for k, p in pages.items()}}

    def cleared(f: Callable[[], None]) -> dict:
        f()
        return {"cleared": True}

    symbols = lambda df, b: paged("symbols", df, b)
    return {
        ("GET", "/health"): lambda b: {"status": "ok", "version": VERSION},
        ("GET", "/ping"): lambda b: {"pong": True},
        ("POST", "/index/directory"): lambda b: engine.index_directory(folder(b), bool(b.get("clear")), b.get("metadata")),
        ("POST", "/index/file"): lambda b: {"chunks": engine.index_file(folder({"path": b.get("root")}), b["file"])},
        ("GET", "/index/stats"): lambda b: listed(engine.vectors.stats())[0],
        ("DELETE", "/index/file"): lambda b: {"deleted": engine.delete_file(b["file"])},
        ("DELETE", "/index/clear"): lambda b: cleared(engine.vectors.clear),
        ("POST", "/search"): lambda b: search(b, False),
        ("POST", "/search/rerank"): lambda b: search(b, True),
        ("POST", "/graph/index"): graph(lambda b: engine.index_graph(folder(b), bool(b.get("clear")))),
        ("GET", "/graph/stats"): graph(lambda b: listed(engine.graph.stats())[0]),
        ("DELETE", "/graph/clear"): graph(lambda b: cleared(engine.graph.clear)),
        ("POST", "/graph/symbol/search"): graph(lambda b: symbols(engine.find_symbols(b.get("name"), b.get("file_path"), b.get("decorator"), b.get("kind")), b)),
        ("POST", "/graph/callers"): graph(lambda b: symbols(engine.callers(wanted(b), int(b.get("depth", 1))), b)),
        ("POST", "/graph/callees"): graph(lambda b: symbols(engine.callees(wanted(b), int(b.get("depth", 1))), b)),
        ("POST", "/graph/call-path"): graph(lambda b: {"path": engine.call_path(b["from"], b["to"])}),
        ("POST", "/graph/import-graph"): graph(lambda b: paged("files", engine.import_graph(b["file_id"]), b)),
        ("POST", "/graph/subclasses"): graph(lambda b: symbols(engine.subclasses(wanted(b)), b)),
        ("POST", "/graph/superclasses"): graph(lambda b: symbols(engine.superclasses(wanted(b)), b)),
        ("POST", "/graph/context"): graph(lambda b: {"context": listed(engine.context(wanted(b)))[0], "text": engine.context_text(wanted(b))}),
        ("POST", "/graph/impact"): graph(impact),
    }


def answer(engine: Engine, api: ApiSettings, method: str, path: str, body: dict, token: str = "") -> tuple[int, object]:
    """Status and answer of one request; every failure has a status of its own."""
    if api.api_key and path not in PUBLIC and token != f"Bearer {api.api_key}":
        return 401, {"error": "a bearer token is needed"}
    known = routes(engine, api)
    try:
        if (method, path) in known:
            return 200, known[method, path](body)
        if method == "GET" and path.startswith("/graph/symbol/"):
            hit = listed(engine.find_symbols().filter(f"id = '{int(path.rsplit('/', 1)[1], 16):016x}'"))
            return (200, hit[0]) if hit else (404, {"error": "no such symbol"})
        if method == "GET" and path.startswith("/graph/file/") and path.endswith("/symbols"):
            return 200, {"symbols": listed(engine.symbols_in_file(path.split("/")[3]))}
        return 404, {"error": f"no route {method} {path}"}
    except Refused as e:
        return e.status, {"error": str(e)}
    except NotFound as e:
        return 404, {"error": f"no symbol {e}"}
    except (KeyError, ValueError, TypeError) as e:
        return 422, {"error": f"{type(e).__name__}: {e}"}


def serve(engine: Engine, api: ApiSettings | None = None) -> ThreadingHTTPServer:
    """A server that is bound and not yet running: call serve_forever()."""
    api = api or engine.settings.api

    class Handler(BaseHTTPRequestHandler):
        def handle_any(self) -> None:
            start = time.time()
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size) or b"{}") if size else {}
                status, found = answer(engine, api, self.command, self.path.split("?")[0].rstrip("/") or "/", body, self.headers.get("Authorization", ""))
            except json.JSONDecodeError as e:
                status, found = 400, {"error": f"no JSON: {e}"}
            except Exception as e:  # noqa: BLE001 - the server goes on
                log.exception("%s %s", self.command, self.path)
                status, found = 500, {"error": type(e).__name__}
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(data)
            log.info("%s %s %d %.0f ms", self.command, self.path, status, 1000 * (time.time() - start))

        do_GET = do_POST = do_DELETE = handle_any

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((api.host, api.port), Handler)

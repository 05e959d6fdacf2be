import json
import threading
import urllib.error
import urllib.request

from strataloom.api import Engine
from strataloom.service import serve
from strataloom.sources.settings import ApiSettings, load


def ask(port, method, path, body=None, token=None):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", json.dumps(body).encode() if body is not None else None, {"Authorization": token} if token else {}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_service(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.py").write_text("def outer(x):\n    return inner(x)\n\n\ndef inner(x):\n    return x\n")
    settings = load(env={"GRAPH_ENABLED": "true", "CHUNKER_MIN_CHUNK_SIZE": "1", "EMBEDDING_DIMENSIONS": "16"}, dotenv=None)
    server = serve(Engine(spark, str(tmp_path / "home"), settings), ApiSettings("127.0.0.1", 0, "secret"))
    port = server.server_address[1]
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        key = "Bearer secret"
        assert ask(port, "GET", "/health") == (200, {"status": "ok", "version": "0.1"}) and ask(port, "GET", "/ping") == (200, {"pong": True})
        assert ask(port, "GET", "/index/stats")[0] == 401
        assert ask(port, "POST", "/index/directory", {"path": "/no/such"}, key)[0] == 404
        assert ask(port, "POST", "/index/directory", {"path": str(source)}, key)[1]["files"] == 1
        status, found = ask(port, "POST", "/search", {"query": "inner", "top_k": 1}, key)
        assert status == 200 and found["total"] == 1
        assert ask(port, "POST", "/search", {"query": "x", "top_k": 0}, key)[0] == 422
        assert ask(port, "POST", "/graph/index", {"path": str(source)}, key)[1]["symbols"] == 2
        assert [s["name"] for s in ask(port, "POST", "/graph/callers", {"name": "inner"}, key)[1]["symbols"]] == ["outer"]
        whole = ask(port, "POST", "/graph/symbol/search", {}, key)[1]
        pages = [ask(port, "POST", "/graph/symbol/search", {"offset": k, "limit": 1}, key)[1] for k in range(2)]
        assert whole["total"] == 2 and [p["total"] for p in pages] == [2, 2] and [p["symbols"][0] for p in pages] == whole["symbols"]
        assert ask(port, "POST", "/graph/symbol/search", {"offset": -1}, key)[0] == 422
        impact = ask(port, "POST", "/graph/impact", {"name": "inner"}, key)[1]
        assert impact["totals"]["callers"] == len(impact["callers"]) == 1
        assert ask(port, "POST", "/graph/callers", {"name": "nobody"}, key)[0] == 404 and ask(port, "POST", "/graph/callers", {}, key)[0] == 422
        assert ask(port, "GET", "/nowhere", None, key)[0] == 404
    finally:
        server.shutdown()

"""Request handlers over a store: HTTP-, MCP- and LSP-shaped messages as plain dictionaries, and a command line.

Handlers are functions of a message; http_server puts them behind a socket. The search behind them is the same plan as for query sets.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, BinaryIO, TextIO

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .errors import ConfigError, EngineError, NotImplementedYet
from .functions.embed import hash_embed, hash_model_id
from .functions.enhance import rule_enhance
from .operators.context import heading_display, lines_display, preview
from .operators.evaluate import per_query, report
from .operators.filters import Filters
from .operators.retrieve import Options, migration_text, passthrough, retrieve, stub_rerank
from .sources.corpus import folder_counts, scan, unpack
from .sources.index import Store, index_folder
from .sources.querysets import load_queries
from .streaming.ingest import ingest

DIM = 384


@dataclass
class Engine:
    spark: SparkSession
    store: Store
    embed: Callable[[Column], Column] = lambda c: hash_embed(c, DIM)
    model_id: str = hash_model_id(DIM)
    dim: int = DIM
    corpus_root: str | None = None

    def search(self, queries: list[tuple[str, str]], k: int = 5, enhance: bool = False, expand_parent: bool = False, threshold: float | None = None, filters: Filters | None = None, rerank: bool = False, pre_rerank_k: int = 50, chars: int = 500) -> list[dict[str, Any]]:
        """Hits of (id, text) queries, best first."""
        chunks = self.store.chunks(self.model_id, self.dim)
        o = Options(top_k=k, pre_rerank_k=pre_rerank_k, expand_parent=expand_parent, threshold=threshold, filters=filters or Filters(), fulltext=bool(self.store.manifest()["fulltext"]))
        asked = self.spark.createDataFrame(queries, "query_id string, query string")
        hits = retrieve(asked, chunks, self.embed, o, rule_enhance if enhance else passthrough, stub_rerank if rerank else None, self.store.text_index(), self.store.vector_index())
        shown = hits.select("query_id", "rank", "chunk_id", "score", "vector_score", "bm25_score", F.col("found_by"), "source", "heading_path", heading_display(F.col("heading_path")).alias("heading"), lines_display(F.col("line_range")).alias("lines"), preview(F.col("content"), chars).alias("preview"))
        return [r.asDict() for r in shown.orderBy("query_id", "rank").collect()]  # k rows for each query

    def one(self, text: str, **options: Any) -> list[dict[str, Any]]:
        return self.search([("q", text)], **options)


# ---- HTTP ------------------------------------------------------------------------------------------------------------


def handle_http(engine: Engine, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
    """(status, body) of a request."""
    body = body or {}
    try:
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok", "version": __version__, "model": engine.model_id}
        if (method, path) == ("GET", "/corpus/list"):
            if engine.corpus_root is None:
                return 200, {"folders": []}
            rows = folder_counts(scan(engine.spark, engine.corpus_root)).collect()
            return 200, {"folders": [r.asDict() for r in rows]}
        if (method, path) == ("POST", "/search"):
            if not isinstance(body.get("query"), str):
                raise ConfigError("query is missing")
            began = time.monotonic()
            hits = engine.one(body["query"], k=int(body.get("k", 5)), enhance=bool(body.get("enhance_query", False)), expand_parent=bool(body.get("expand_parent", False)))
            return 200, {"hits": hits, "elapsed_ms": int(1000 * (time.monotonic() - began))}
        if (method, path) == ("POST", "/index"):
            raise NotImplementedYet("indexing over HTTP")
        return 404, {"error": "not_found", "message": path}
    except EngineError as e:
        return e.status, {"error": type(e).__name__, "message": str(e)}


# ---- JSON-RPC --------------------------------------------------------------------------------------------------------

_SCHEMA = {"type": "object", "properties": {"query": {"type": "string"}, "k": {"type": "integer"}, "expand_parent": {"type": "boolean"}}, "required": ["query"]}
TOOLS = (
    {"name": "search_docs", "description": "Search the documentation.", "inputSchema": _SCHEMA},
    {"name": "search_code", "description": "Search for examples; expands to the enclosing section by default.", "inputSchema": _SCHEMA},
    {"name": "migrate", "description": "Find what a construct of another platform becomes.", "inputSchema": {"type": "object", "properties": {"code": {"type": "string"}, "from": {"type": "string"}}, "required": ["code", "from"]}},
    {"name": "validate", "description": "Size of a piece of code.", "inputSchema": {"type": "object", "properties": {"code": {"type": "string"}}, "required": ["code"]}},
)


def _error(ident: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}


def _result(ident: Any, result: Any) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def _hits_text(title: str, hits: list[dict]) -> str:
    return "\n\n".join([f"## {title}"] + [f"{h['rank']}. {h['heading']} ({h['source']} {h['lines']}, score {h['score']:.4f})\n{h['preview']}" for h in hits]) if hits else f"## {title}\n\nNothing found."


def _call(engine: Engine, name: str, a: dict) -> str:
    if name in ("search_docs", "search_code"):
        if not isinstance(a.get("query"), str):
            raise ConfigError("query is missing")
        code = name == "search_code"
        return _hits_text("Code" if code else "Documents", engine.one(a["query"], k=int(a.get("k", 5)), enhance=True, expand_parent=bool(a.get("expand_parent", code)), chars=800))
    if name == "migrate":
        if not isinstance(a.get("code"), str) or not isinstance(a.get("from"), str):
            raise ConfigError("code and from are needed")
        return _hits_text("Migration", engine.one(migration_text(a["from"], a["code"], "the target platform"), k=5, enhance=True, chars=800))
    if name == "validate":
        return json.dumps({"length": len(str(a.get("code", "")))})
    raise ConfigError(f"no such tool: {name}")


def handle_mcp(engine: Engine, line: str) -> dict | None:
    """The answer to one line; None for notifications."""
    try:
        m = json.loads(line)
    except ValueError:
        return _error(None, -32700, "not JSON")
    if not isinstance(m, dict) or "method" not in m:
        return _error(m.get("id") if isinstance(m, dict) else None, -32600, "not a request")
    if "id" not in m:
        return None
    ident, method, params = m["id"], m["method"], m.get("params") or {}
    if method == "initialize":
        return _result(ident, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tidewell", "version": __version__}})
    if method == "ping":
        return _result(ident, {})
    if method == "tools/list":
        return _result(ident, {"tools": list(TOOLS)})
    if method == "tools/call":
        if not isinstance(params.get("name"), str):
            return _error(ident, -32602, "a tool name is needed")
        try:
            return _result(ident, {"content": [{"type": "text", "text": _call(engine, params["name"], params.get("arguments") or {})}], "isError": False})
        except ConfigError as e:
            return _error(ident, -32602, str(e))
        except EngineError as e:
            return _error(ident, -32603, str(e))
    return _error(ident, -32601, f"no such method: {method}")


class LspSession:
    """Messages of an editor: initialize, shutdown, exit, hover, and custom search and migrate requests."""

    def __init__(self, engine: Engine):
        self.engine, self.down, self.ended = engine, False, False

    def handle(self, m: dict) -> dict | None:
        ident, method, params = m.get("id"), m.get("method"), m.get("params") or {}
        if method == "exit":
            self.ended = True
            return None
        if ident is None:
            return None
        if self.down:
            return _error(ident, -32600, "the server is shut down")
        if method == "initialize":
            return _result(ident, {"capabilities": {"hoverProvider": True}, "serverInfo": {"name": "tidewell", "version": __version__}})
        if method == "shutdown":
            self.down = True
            return _result(ident, None)
        if method == "textDocument/hover":
            return _result(ident, None)
        if method == "tidewell/search":
            if not isinstance(params.get("query"), str):
                return _error(ident, -32602, "query is missing")
            try:
                return _result(ident, {"hits": self.engine.one(params["query"], k=int(params.get("k", 5)))})
            except EngineError as e:
                return _error(ident, -32603, str(e))
        if method == "tidewell/migrate":
            return _result(ident, {"status": "not implemented"})
        return _error(ident, -32601, f"no such method: {method}")


def read_frame(stream: BinaryIO) -> dict | None:
    """One message with a Content-Length header; None at the end."""
    length = None
    while True:
        line = stream.readline()
        if not line:
            return None
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.decode("ascii", "replace").partition(":")
        if name.strip().lower() == "content-length":
            length = int(value)
    if length is None:
        raise ConfigError("a message without Content-Length")
    return json.loads(stream.read(length))


def write_frame(stream: BinaryIO, message: dict) -> None:
    body = json.dumps(message).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    stream.flush()


def serve_mcp(engine: Engine, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if line.strip():
            answer = handle_mcp(engine, line)
            if answer is not None:
                print(json.dumps(answer), file=out, flush=True)


def serve_lsp(engine: Engine, lines: BinaryIO, out: BinaryIO) -> None:
    session = LspSession(engine)
    while not session.ended and (m := read_frame(lines)) is not None:
        answer = session.handle(m)
        if answer is not None:
            write_frame(out, answer)


def http_server(engine: Engine, host: str = "127.0.0.1", port: int = 7654) -> ThreadingHTTPServer:
    """A server that answers with handle_http; the caller runs and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else {}
                status, answer = handle_http(engine, method, self.path.split("?")[0], body) if isinstance(body, dict) else (400, {"error": "ConfigError", "message": "not an object"})
            except ValueError:
                status, answer = 400, {"error": "ConfigError", "message": "not JSON"}
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


# ---- evaluation and command line -------------------------------------------------------------------------------------


def evaluate(engine: Engine, path: str, k: int = 5, enhance: bool = False, rerank: bool = False, run_at: str = "") -> str:
    """The report of an evaluation set; the whole set is one retrieval."""
    truth = load_queries(engine.spark, path)
    chunks = engine.store.chunks(engine.model_id, engine.dim)
    o = replace(Options(top_k=k), fulltext=bool(engine.store.manifest()["fulltext"]))
    began = time.monotonic()
    hits = retrieve(truth.select("query_id", "query"), chunks, engine.embed, o, rule_enhance if enhance else passthrough, stub_rerank if rerank else None, engine.store.text_index(), engine.store.vector_index())
    results = per_query(hits.select("query_id", "rank", "chunk_id"), truth, k).cache()
    n = max(1, results.count())
    each = int(1000 * (time.monotonic() - began) / n)
    return report(results.withColumn("latency_ms", F.lit(each).cast("long")), "Retrieval evaluation", run_at)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell")
    p.add_argument("--index", default="index", help="folder of the store")
    p.add_argument("--dim", type=int, default=DIM)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("source")
    i.add_argument("--no-fulltext", action="store_true")
    i.add_argument("--checkpoint", help="folder of the progress; indexes what is new since the last run")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("-k", type=int, default=5)
    q.add_argument("--enhance", action="store_true")
    q.add_argument("--expand-parent", action="store_true")
    q.add_argument("--threshold", type=float)
    q.add_argument("--rerank", action="store_true")
    q.add_argument("--pre-rerank-k", type=int, default=50)
    c = sub.add_parser("corpus").add_subparsers(dest="action", required=True)
    c.add_parser("list").add_argument("source")
    for name in ("pull", "index-pull"):
        pull = c.add_parser(name, help="unpack a local archive")
        pull.add_argument("--from-file", required=True)
        pull.add_argument("--target", required=True)
        pull.add_argument("--force", action="store_true")
        pull.add_argument("--strip-components", type=int, default=0)
    e = sub.add_parser("eval")
    e.add_argument("queries")
    e.add_argument("-k", type=int, default=5)
    e.add_argument("--enhance", action="store_true")
    e.add_argument("--rerank", action="store_true")
    s = sub.add_parser("serve")
    s.add_argument("--protocol", choices=("mcp", "lsp", "http"), default="mcp")
    s.add_argument("--addr", default="127.0.0.1:7654")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "corpus" and a.action != "list":
        print(unpack(a.from_file, a.target, a.force, a.strip_components))
        return 0
    from .session import session

    spark = session()
    engine = Engine(spark, Store(spark, a.index, read_only=a.command != "index"), lambda x: hash_embed(x, a.dim), hash_model_id(a.dim), a.dim)
    if a.command == "index" and a.checkpoint:
        engine.store.open_or_create(engine.model_id, a.dim, not a.no_fulltext)
        ingest(spark, a.source, engine.store, a.checkpoint, engine.embed, engine.model_id, a.dim).awaitTermination()
        print(json.dumps({"chunks": engine.store.count()}))
    elif a.command == "index":
        print(json.dumps(index_folder(spark, a.source, engine.store, engine.embed, engine.model_id, a.dim, fulltext=not a.no_fulltext)))
    elif a.command == "query":
        hits = engine.one(a.text, k=a.k, enhance=a.enhance, expand_parent=a.expand_parent, threshold=a.threshold, rerank=a.rerank, pre_rerank_k=a.pre_rerank_k, chars=200)
        print("\n".join(f"{h['rank']}. [{h['score']:.4f}] {h['source']} {h['lines']} {h['heading']}\n   {h['preview']}" for h in hits) or "Nothing found.")
    elif a.command == "corpus":
        for r in folder_counts(scan(spark, a.source)).collect():
            print(r["folder"], r["n"])
    elif a.command == "eval":
        print(evaluate(engine, a.queries, a.k, a.enhance, a.rerank, run_at=time.strftime("%Y-%m-%d %H:%M:%S")))
    elif a.protocol == "http":
        host, _, port = a.addr.rpartition(":")
        with http_server(engine, host, int(port)) as server:
            server.serve_forever()
    elif a.protocol == "mcp":
        serve_mcp(engine, sys.stdin, sys.stdout)
    else:
        serve_lsp(engine, sys.stdin.buffer, sys.stdout.buffer)
    return 0


if __name__ == "__main__":
    sys.exit(main())

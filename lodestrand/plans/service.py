"""The query surface over HTTP and over JSON-RPC on standard streams, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import BinaryIO
from urllib.parse import parse_qs, urlsplit

from lodestrand.plans import cases
from lodestrand.plans.engine import Engine

PORT = 8765
#: Tool, the argument that it needs, and what it does.
TOOLS = {
    "get_context": ("task", "Compact context for a task in words."),
    "get_symbol": ("name", "Compact context around a symbol."),
    "get_file": ("path", "Compact context around a file; the path may be relative to the root."),
    "expand_context": ("handle", "What is behind one expansion handle."),
    "get_stats": (None, "State and counts of the index."),
    "get_status": (None, "State of the index."),
}
QUERY_KINDS = {"get_context": "task", "get_symbol": "symbol", "get_file": "file"}
ROUTES = {"/context": "get_context", "/context/symbol": "get_symbol", "/context/file": "get_file", "/context/expand": "expand_context", "/stats": "get_stats", "/status": "get_status", "/health": "get_status"}
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602


class Service:
    """Answers requests with ``engine``; ``reindex`` makes a new one."""

    def __init__(self, engine: Engine, reindex: Callable[[], Engine] | None = None):
        self.engine, self.reindex = engine, reindex

    def call(self, tool: str, value: str | None, detail: str | None) -> str:
        if tool in QUERY_KINDS:
            return self.engine.retrieve(QUERY_KINDS[tool], value or "", "full" if detail == "full" else "compact")
        if tool == "expand_context":
            return self.engine.expand(value or "")
        return self.engine.status(counts=tool == "get_stats")

    def http(self, method: str, target: str) -> tuple[int, str, str]:
        """(code, content type, body) of a request."""
        url = urlsplit(target)
        query = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        as_json = "application/json"
        if url.path == "/reindex" and method == "POST":
            if self.reindex is None:
                return 503, as_json, '{"error":"reindex not available"}'
            self.engine = self.reindex()
            return 200, as_json, '{"status":"reindex_started"}'
        tool = ROUTES.get(url.path)
        if tool is None:
            return 404, as_json, '{"error":"not found"}'
        needed = TOOLS[tool][0]
        if needed is None:
            return 200, as_json, self.call(tool, None, None)
        if not query.get(needed):
            return 400, as_json, json.dumps({"error": "missing handle parameter" if needed == "handle" else "missing required parameter"})
        return 200, "text/plain; charset=utf-8", self.call(tool, query[needed], query.get("detail"))

    def rpc(self, text: str) -> dict | None:
        """The response to one message; None for notifications."""
        try:
            message = json.loads(text)
        except ValueError:
            return _error(None, PARSE_ERROR, "parse error")
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return _error(message.get("id") if isinstance(message, dict) else None, INVALID_REQUEST, "invalid request")
        id, method, params = message.get("id"), message["method"], message.get("params")
        if method.startswith("notifications/"):
            return None
        if method == "initialize":
            return _result(id, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestrand", "version": "1"}})
        if method == "ping":
            return _result(id, {})
        if method == "tools/list":
            return _result(id, {"tools": [_tool(name) for name in TOOLS]})
        if method != "tools/call":
            return _error(id, NO_METHOD, "method not found")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str):
            return _error(id, INVALID_PARAMS, "missing tool name" if isinstance(params, dict) else "missing params")
        tool, arguments = params["name"], params.get("arguments") or {}
        if tool not in TOOLS:
            return _error(id, NO_METHOD, "unknown tool")
        needed = TOOLS[tool][0]
        if needed and not isinstance(arguments.get(needed), str):
            return _error(id, INVALID_PARAMS, f"missing '{needed}'")
        return _result(id, {"content": [{"type": "text", "text": self.call(tool, arguments.get(needed), arguments.get("detail"))}]})

    def serve_streams(self, source: BinaryIO, sink: BinaryIO) -> None:
        """Messages as bare lines or with a Content-Length header; answers always have the header."""
        while line := source.readline():
            if line.lower().startswith(b"content-length:"):
                size = int(line.split(b":", 1)[1])
                while source.readline().strip():
                    pass
                text = source.read(size)
            elif line.strip():
                text = line
            else:
                continue
            if (answer := self.rpc(text.decode("utf-8", "replace"))) is not None:
                body = json.dumps(answer).encode()
                sink.write(b"Content-Length: %d\r\n\r\n%s" % (len(body), body))
                sink.flush()

    def serve_http(self, port: int = PORT) -> None:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                code, kind, body = service.http(self.command, self.path)
                data = body.encode()
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_POST = do_GET

        HTTPServer(("127.0.0.1", port), Handler).serve_forever()


def _tool(name: str) -> dict:
    needed, about = TOOLS[name]
    properties = {needed: {"type": "string"}} if needed else {}
    if name in QUERY_KINDS:
        properties["detail"] = {"type": "string", "enum": ["compact", "standard", "full"]}
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": [needed] if needed else []}}


def _result(id, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": id, "result": result}


def _error(id, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": id, "error": {"code": code, "message": text}}


def main(arguments: list[str] | None = None) -> None:
    """Indexes a tree and serves it: over HTTP, or with --stdio over the standard streams."""
    parser = argparse.ArgumentParser(prog="lodestrand")
    parser.add_argument("tree")
    parser.add_argument("--store", required=True)
    parser.add_argument("--port", type=int, default=PORT)
    parser.add_argument("--stdio", action="store_true")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--cases", action="store_true", help="run the presence cases and leave")
    options = parser.parse_args(arguments)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestrand").getOrCreate()
    build = lambda forced=False: Engine.index(spark, options.tree, options.store, forced)
    service = Service(build(options.force), build)
    if options.cases:
        outcomes = cases.run(service.engine)
        sys.stdout.write(cases.report(outcomes))
        sys.exit(sum(o.missing is not None for o in outcomes))
    if options.stdio:
        service.serve_streams(sys.stdin.buffer, sys.stdout.buffer)
    else:
        service.serve_http(options.port)


if __name__ == "__main__":
    main()

"""The engine's tools by name, over standard input and output or HTTP."""

from __future__ import annotations

import inspect
import json
import logging
import os
import sys
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from logging.handlers import RotatingFileHandler
from typing import TextIO
from urllib.parse import parse_qs, urlparse

from loamdex.engine import Engine
from loamdex.settings import Settings

LOG = logging.getLogger("loamdex.tools")
TOOLS = ("search_text", "search_symbol", "file_symbols", "read_span", "search_semantic", "search_hybrid", "list_services", "reindex", "reindex_background", "index_stats")


def log_to_file(s: Settings) -> None:
    """Tools log to a rotating file only: standard output carries the protocol."""
    os.makedirs(os.path.dirname(s.log_file), exist_ok=True)
    handler = RotatingFileHandler(s.log_file, maxBytes=s.log_max_bytes, backupCount=s.log_backups, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    LOG.addHandler(handler)
    LOG.setLevel(s.log_level)
    LOG.propagate = False


class Tools:
    """Calls tools, with a line in the log at start, end, failure and when a call takes long."""

    def __init__(self, engine: Engine, slow: float = 2.0):
        self.engine, self.slow = engine, slow
        self.calls: dict[str, Callable[..., str]] = {n: getattr(engine, n) for n in TOOLS}
        self.calls["reindex"] = self._reindex

    def _reindex(self, full: bool = False, service: str | None = None) -> str:
        """Runs the index of a service and waits for it."""
        r = self.engine.reindex(service, full)
        return f"indexed={r.indexed} skipped={r.skipped} removed={r.removed} symbols={r.symbols} semantic_files={r.semantic_files} semantic={'on' if r.semantic_enabled else 'off'}"

    def described(self) -> list[dict]:
        """Names and parameters; those without a default are required."""
        out = []
        for name, call in self.calls.items():
            ps = inspect.signature(call).parameters.values()
            kinds = {p.name: {"int": "integer", "bool": "boolean", "float": "number"}.get(getattr(p.annotation, "__name__", str(p.annotation)).split(" ")[0], "string") for p in ps}
            out.append({"name": name, "description": (call.__doc__ or name.replace("_", " ")).strip(), "inputSchema": {"type": "object", "properties": {n: {"type": k} for n, k in kinds.items()}, "required": [p.name for p in ps if p.default is p.empty]}})
        return out

    def call(self, name: str, arguments: dict) -> str:
        if name not in self.calls:
            raise ValueError(f"unknown tool: {name}")
        if name == "reindex_background":
            arguments = {("wanted" if k == "service" else k): v for k, v in arguments.items()}
        began = time.time()
        LOG.info("%s starts %.200r", name, arguments)
        late = threading.Timer(self.slow, LOG.warning, ("%s is slow: over %.1f s", name, self.slow))
        late.daemon = True
        late.start()
        try:
            out = self.calls[name](**arguments)
        except Exception:
            LOG.exception("%s failed after %.2f s", name, time.time() - began)
            raise
        finally:
            late.cancel()
        LOG.info("%s took %.2f s", name, time.time() - began)
        return out


def serve_lines(tools: Tools, source: TextIO | None = None, target: TextIO | None = None) -> None:
    """JSON-RPC 2.0, a message a line: initialize, tools/list, tools/call."""
    source, target = source or sys.stdin, target or sys.stdout
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            answer = _answer(tools, message) if isinstance(message, dict) else {"error": {"code": -32600, "message": "not a request"}}
        except ValueError:
            message, answer = {"id": None}, {"error": {"code": -32700, "message": "not JSON"}}
        if answer is not None:
            target.write(json.dumps({"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, **answer}) + "\n")
            target.flush()


def _answer(tools: Tools, message: dict) -> dict | None:
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    if method == "initialize":
        return {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loamdex", "version": "1"}}}
    if method == "tools/list":
        return {"result": {"tools": tools.described()}}
    if method == "tools/call":
        try:
            text, failed = tools.call(params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:
            text, failed = f"{type(e).__name__}: {e}", True
        return {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return {"error": {"code": -32601, "message": f"unknown method {method}"}}


_PAGE = """<!doctype html><meta charset="utf-8"><title>loamdex</title><table id="t"></table><script>
async function show(){const r=await(await fetch('/api/status')).json();
document.getElementById('t').innerHTML=r.services.map(s=>`<tr><td>${s.name}<td>${s.phase}<td>${s.done}/${s.total}<td>${s.files??'?'} files<td>${s.symbols??'?'} symbols<td>
<button onclick="fetch('/api/reindex?service=${encodeURIComponent(s.id)}',{method:'POST'})">reindex</button>`).join('')}
show();setInterval(show,2000)</script>"""


def http_server(engine: Engine, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """GET / and /api/status, POST /api/reindex?service=&full=; not yet started."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: bytes, kind: str) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, code: int, value: dict) -> None:
            self._send(code, json.dumps(value).encode(), "application/json")

        def do_GET(self) -> None:  # noqa: N802
            path = urlparse(self.path).path
            if path in ("/", "/index.html"):
                self._send(200, _PAGE.encode(), "text/html; charset=utf-8")
            elif path == "/api/status":
                self._json(200, {"services": engine.snapshot()})
            else:
                self._send(404, b"not found", "text/plain")

        def do_POST(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            if url.path != "/api/reindex":
                self._send(404, b"not found", "text/plain")
                return
            asked = parse_qs(url.query)
            wanted, full = asked.get("service", [""])[0], asked.get("full", ["0"])[0] in ("1", "true", "yes")
            known = next((s for s in engine.services if s.id == wanted), None)
            if known is None:
                self._json(404, {"ok": False, "error": "unknown service"})
                return
            said = engine.reindex_background(known.id, full)
            self._json(200, {"ok": said.startswith("reindex started"), "status": said, "service": known.id, "full": full})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

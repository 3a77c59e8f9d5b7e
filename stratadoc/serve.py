"""The engine over HTTP: requests as small batches of one, answers as JSON or as server-sent events."""

from __future__ import annotations

import hmac
import json
import os
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import functions as F

from stratadoc import schema
from stratadoc.plans import pages
from stratadoc.plans.engine import Engine
from stratadoc.sources import readers

MOST_BYTES = 100_000


class Failed(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Service:
    """What each path does, apart from HTTP: ``call`` gives status, content type and body."""

    def __init__(self, engine: Engine, token: str = "", static: str | None = None, distance: float = 1.0):
        self.engine, self.token, self.distance = engine, token, distance
        self.static = Path(static).resolve() if static else None
        self.paths: dict[tuple[str, str], Callable[[dict, dict], object]] = {
            ("GET", "/health"): lambda *_: engine.health(), ("GET", "/smoke"): lambda *_: engine.smoke(), ("GET", "/filters"): lambda *_: engine.facets(),
            ("GET", "/config"): lambda *_: {"environment": engine.settings.environment}, ("GET", "/standards/list"): lambda *_: [r.asDict() for r in engine.catalogue().collect()],
            ("GET", "/standards"): lambda *_: pages.catalogue_page(engine.chunks()), ("GET", "/analytics"): self.analytics, ("POST", "/query"): self.query,
            ("POST", "/query/stream"): self.stream, ("POST", "/correct"): self.correct, ("POST", "/request"): self.request, ("POST", "/analytics/event"): self.event,
        }

    def call(self, method: str, path: str, headers: dict[str, str], body: bytes) -> tuple[int, str, bytes]:
        try:
            handler = self.paths.get((method, path.split("?")[0]))
            if handler is None:
                return self.file(path) if method == "GET" and self.static else (404, "application/json", b'{"detail": "not found"}')
            try:
                given = json.loads(body) if body else {}
            except ValueError:
                raise Failed(400, "the body is not JSON") from None
            out = handler(given if isinstance(given, dict) else {}, headers)
        except Failed as error:
            return error.status, "application/json", json.dumps({"detail": str(error)}).encode()
        if isinstance(out, str):
            return 200, "text/event-stream" if out.startswith("data:") else "text/html; charset=utf-8", out.encode()
        return 200, "application/json", json.dumps(out, default=str).encode()

    def file(self, path: str) -> tuple[int, str, bytes]:
        at = (self.static / path.split("?")[0].lstrip("/")).resolve()
        at = at / "index.html" if at.is_dir() else at
        if not at.is_relative_to(self.static) or not at.is_file():
            return 404, "application/json", b'{"detail": "not found"}'
        kinds = {".html": "text/html; charset=utf-8", ".js": "text/javascript", ".css": "text/css", ".json": "application/json"}
        return 200, kinds.get(at.suffix, "application/octet-stream"), at.read_bytes()

    def _frame(self, ddl: str, *rows: tuple):
        return self.engine.spark.createDataFrame(list(rows), ddl)

    def _answered(self, given: dict):
        query = str(given.get("query") or "").strip()
        if not query:
            raise Failed(422, "a query is needed")
        facets = [c for c in schema.T.StructType.fromDDL(schema.REQUEST).names if c != "query"]
        row = (uuid.uuid4().hex, query, *(str(given.get(f) or "") for f in facets))
        return self.engine.answer(self._frame("query_id string, query string, " + ", ".join(f"{f} string" for f in facets), row), distance=self.distance)

    def query(self, given: dict, _) -> object:
        row = self._answered(given).first()
        return {"answer": row.answer, "context": row.prompt}

    def stream(self, given: dict, _) -> str:
        events = self.engine.events(self._answered(given)).withColumn("stream_id", F.col("query_id")).orderBy("seq")
        return "".join(f"{r.value}\n\n" for r in readers.sse_lines(events).orderBy("seq").collect())

    def correct(self, given: dict, headers: dict) -> object:
        if self.token and not hmac.compare_digest(headers.get("x-token", ""), self.token):
            raise Failed(403, "a token is needed")
        rows = [(c.get("source_file"), c.get("page"), c.get("chunk_index"), c.get("section")) for c in given.get("corrections", []) if isinstance(c, dict)]
        if not rows:
            raise Failed(422, "corrections are needed")
        bad = self.engine.correct(self._frame("source_file string, page int, chunk_index int, section string", *rows)).count()
        return {"received": len(rows), "refused": bad}

    def request(self, given: dict, _) -> object:
        row = tuple(str(given.get(c) or "") for c in ("document", "notes", "email"))
        if self.engine.request_document(self._frame("document string, notes string, email string", row)).count():
            raise Failed(422, "the request names no document or is too long")
        return {"ok": True}

    def event(self, given: dict, headers: dict) -> object:
        self.engine.record(self._frame("kind string, key string, client string, delta int", (given.get("kind"), given.get("key"), headers.get("client", ""), 1)).withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
        return {"ok": True}

    def analytics(self, _, headers: dict) -> object:
        days, totals = self.engine.dashboard()
        return pages.usage_page(days, totals) if "text/html" in headers.get("accept", "") else {"days": days, "totals": totals}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for ``service``; ``serve_forever`` starts it."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("content-length") or 0)
            headers = {k.lower(): v for k, v in self.headers.items()} | {"client": self.client_address[0]}
            status, kind, body = (413, "application/json", b'{"detail": "too long"}') if size > MOST_BYTES else service.call(self.command, self.path, headers, self.rfile.read(size))
            self.send_response(status)
            self.send_header("content-type", kind)
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _do

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def from_environment(engine: Engine) -> Service:
    return Service(engine, os.environ.get("STRATADOC_TOKEN", ""), os.environ.get("STRATADOC_STATIC"))

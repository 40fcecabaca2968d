"""The verbs of the service: search, stats, health, index; and a small HTTP server for the first three."""

from __future__ import annotations

import json
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import indexing, retrieval
from .plans.schema import Settings
from .sources import folders, markdown, providers


class BadRequest(ValueError):
    """A request that the service refuses."""


def check_request(query, limit) -> tuple[str, int]:
    """query and limit of a request; a limit that is None or 0 is 5. A query is text, a limit a whole number not below 0."""
    if query is None or query == "":
        raise BadRequest("a query is needed")
    if not isinstance(query, str):
        raise BadRequest("the query must be a string")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int)):
        raise BadRequest("the limit must be a whole number")
    if limit is not None and limit < 0:
        raise BadRequest("limit must not be negative")
    return query, limit or 5


def parse_request(body: str | bytes) -> tuple[str, int]:
    """query and limit of a JSON request."""
    try:
        data = json.loads(body)
    except ValueError as e:
        raise BadRequest("the request is not valid JSON") from e
    if not isinstance(data, dict):
        raise BadRequest("the request is not a JSON object")
    return check_request(data.get("query"), data.get("limit"))


class Engine:
    """embedder and chat come from the settings unless they are given."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder=None, chat=None, language: str | None = None):
        self.spark, self.settings = spark, settings or Settings.load()
        s = self.settings
        self.embedder = embedder or providers.embedding_provider(s.embedding_model, s.dims, s.model_host)
        self.chat = chat or providers.chat_provider(s.chat_backend, s.remote_url if s.chat_backend.strip().lower() == "remote" else s.model_host, s.chat_key.strip(), s.chat_model.strip())
        self.language = language or s.language

    @property
    def chunks(self):
        return indexing.read_table(self.spark, self.settings.table_path)

    def index(self) -> dict[str, int]:
        """Index the folder of the settings, or the samples if there is none; the run's counters."""
        s = self.settings
        rest = (s.table_path, self.embedder, s.dims, self.language, s.tokens == "all")
        if not markdown.is_local(s.docs_dir) or os.path.isdir(markdown.local_path(s.docs_dir)):
            files = folders.files_below(self.spark, s.docs_dir) if markdown.opens(s.docs_dir) else markdown.scan_markdown(self.spark, s.docs_dir)
            out = indexing.index_files(files, *rest)
        else:
            out = indexing.index_samples(self.spark, *rest)
        if s.search == "index":
            self.indexes.update()
        return out

    @property
    def indexes(self) -> indexing.Indexes:
        return indexing.Indexes(self.spark, self.settings.table_path)

    def _hybrid(self, vector, query: str, limit: int):
        if self.settings.search == "index":
            return self.indexes.hybrid_search(vector, query, limit, self.language)
        return retrieval.hybrid_search(self.chunks, vector, query, limit, self.language, self.settings.distances == "blocks")

    def search(self, query: str, limit: int | None = None) -> dict:
        query, limit = check_request(query, limit)
        vector = self.embedder.embed([providers.query_text(self.chat, query)])[0]
        chunks = self.chunks
        found = [r.asDict() for r in self._hybrid(vector, query, limit).collect()]
        if not found:
            return {"results": [], "query": query}
        order = {(r["file_path"], r["chunk_index"]): k for k, r in enumerate(found)}
        centres = self.spark.createDataFrame([(p, c) for p, c in order], "file_path string, centre int")
        windows = retrieval.joined_windows(retrieval.chunk_windows(chunks, F.broadcast(centres))).collect()  # at most `limit` rows
        windows.sort(key=lambda w: order[w.file_path, w.centre])
        results = [{"file_path": w.file_path, "chunk_index": w.centre, "content": w.snippet, "distance": found[order[w.file_path, w.centre]]["distance"]} for w in windows]
        out = {"results": results, "query": query}
        if self.chat:
            ranked = self.spark.createDataFrame([(k, w.file_path, w.context) for k, w in enumerate(windows, 1)], "rank int, file_path string, context string")
            answer = providers.grounded_answer(self.chat, query, retrieval.context_of(ranked).first().context)
            if answer:
                out["answer"] = answer
        return out

    def stats(self) -> dict:
        return indexing.stats(self.spark, self.settings.table_path)

    def health(self) -> dict:
        try:
            self.spark.sql("select 1").collect()
            self.chunks.limit(1).collect()
        except Exception as e:  # whatever is wrong, the answer says so
            return {"status": "unhealthy", "error": str(e)}
        return {"status": "healthy"}


def answer_http(engine: Engine, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON of a request: POST /search, GET /stats, GET /health."""
    verbs = {"/search": "POST", "/stats": "GET", "/health": "GET"}
    if path not in verbs:
        return 404, {"error": "not found"}
    if method != verbs[path]:
        return 405, {"error": f"use {verbs[path]}"}
    try:
        if path == "/search":
            return 200, engine.search(*parse_request(body))
        if path == "/stats":
            return 200, engine.stats()
        found = engine.health()
        return (200 if found["status"] == "healthy" else 503), found
    except BadRequest as e:
        return 400, {"error": str(e)}
    except Exception as e:  # a failing search must not end the server
        return 500, {"error": str(e)}


def serve(engine: Engine, port: int | None = None) -> ThreadingHTTPServer:
    """A server for the engine on the address and port of the settings; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = answer_http(engine, self.command, self.path.split("?")[0], body)
            raw = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((engine.settings.bind, int(engine.settings.port) if port is None else port), Handler)

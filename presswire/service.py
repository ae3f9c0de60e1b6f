"""Requests and answers as a service gives them, and a small HTTP server of them."""

from __future__ import annotations

import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .errors import RequestError, item_error
from .operators.request import parse_json
from .plans.news import get_news
from .settings import Settings
from .sources import http

log = logging.getLogger(__name__)


def documentation() -> dict[str, Any]:
    """The schemas of requests and answers."""
    return {name.lower(): getattr(schemas, name).jsonValue() for name in ("REQUEST", "RESPONSE", "ARTICLE", "ITEM", "CRAWL_REQUEST", "CATALOGUE", "CHAT")}


def handle(spark: SparkSession, method: str, path: str, body: str | bytes | None = None, feeds: DataFrame | None = None, pages: DataFrame | None = None, mode: str = "intended", transport: http.Transport = http.urlopen) -> tuple[int, str]:
    """Status and JSON text of the answer. ``POST /api/news`` answers a request, ``GET
    /healthcheck`` says that a job runs, ``GET /docs`` has the schemas. A request that cannot be
    answered has ``{"error": ...}`` and the status of its error, any other failure 500."""
    try:
        if (method, path) == ("POST", "/api/news"):
            return 200, json.dumps(get_news(spark, parse_json(body), feeds, pages, mode, transport=transport), ensure_ascii=False)
        if (method, path) == ("GET", "/healthcheck"):
            return 200, json.dumps({"status": "ok" if spark.range(1).count() == 1 else "failed"})
        if (method, path) == ("GET", "/docs"):
            return 200, json.dumps(documentation())
        return 404, json.dumps({"error": f"There is nothing at {method} {path}."})
    except RequestError as e:
        log.info("%s %s: %s", method, path, e)
        return e.status, json.dumps(e.body(), ensure_ascii=False)
    except Exception as e:
        log.exception("%s %s", method, path)
        known = item_error(e)
        return 500, json.dumps(known.body() if known else {"error": "The request could not be answered."}, ensure_ascii=False)


def server(spark: SparkSession, settings: Settings | None = None, **options) -> ThreadingHTTPServer:
    """A server on the settings' port; ``serve_forever()`` runs it. ``options`` go to :func:`handle`."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            size = int(self.headers.get("Content-Length") or 0)
            status, text = handle(spark, self.command, self.path.split("?")[0], self.rfile.read(size) if size else None, **options)
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()
            self.wfile.write(text.encode())

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, format, *args):
            log.info(format, *args)

    return ThreadingHTTPServer(("", (settings or Settings.of()).port), Handler)

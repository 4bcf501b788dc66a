"""LogService over HTTP, with the standard library's server: JSON bodies in, JSON out."""

from __future__ import annotations

import json
import logging
import re
import threading
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from tailrace.service import LogService

log = logging.getLogger(__name__)

#: Rows of a frame that an answer carries; beyond them the answer gives their number alone.
MOST_ROWS = 10_000
MOST_BYTES = 1 << 20
Route = Callable[[LogService, dict], object]


def plain(value: object) -> object:
    """Frames as lists of rows, or as their number where there are more than MOST_ROWS."""
    if isinstance(value, DataFrame):
        rows = value.limit(MOST_ROWS + 1).collect()
        return [r.asDict(recursive=True) for r in rows] if len(rows) <= MOST_ROWS else {"rows": value.count()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value


def span(body: dict) -> dict:
    """body with the last seven days where it names no start or end."""
    now = datetime.now(UTC).replace(tzinfo=None)
    return body | {"start_time": body.get("start_time") or str(now - timedelta(days=7)), "end_time": body.get("end_time") or str(now)}


def searched(service: LogService, body: dict) -> dict:
    return {"success": True} | service.search(**body)


def prompted(service: LogService, body: dict) -> dict:
    return service.generate_prompt(**body)


def workflow(service: LogService, body: dict) -> dict:
    return service.dify_workflow(**body)


def processed(output: str | None) -> Route:
    def run(service: LogService, body: dict) -> dict:
        body = span(body)
        save, name = body.pop("save_to_es", True) or body.pop("save_to_file", False), body.pop("target_index", None) or "processed"
        body.pop("save_to_file", None)
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError("target_index must be a plain name")
        made = service.process_logs(**body, target=f"{output}/{name}" if save and output else None)
        return {"status": "success", "record_count": made["record_count"]}

    return run


def vectorised(service: LogService, body: dict) -> dict:
    body = span(body)
    body.pop("service_name_column", None)
    body["content_column"] = body.get("content_column") or "message"
    return {"status": service.vectorize_logs(**body)["status"]}


def in_background(service: LogService, body: dict) -> dict:
    def run() -> None:
        try:
            log.info("background run: %s", service.process_and_vectorize(**body)["status"])
        except Exception:
            log.exception("the background run failed")

    threading.Thread(target=run, daemon=True).start()
    return {"status": "processing"}


def routes(output: str | None = None) -> dict[tuple[str, str], Route]:
    return {
        ("GET", "/"): lambda s, b: {"message": "log analysis service"},
        ("GET", "/health"): lambda s, b: s.health(),
        ("GET", "/api/services"): lambda s, b: {"services": s.services()},
        ("GET", "/api/log_levels"): lambda s, b: {"log_levels": s.log_levels()},
        ("GET", "/api/stats"): lambda s, b: s.stats().first().asDict(recursive=True),
        ("GET", "/api/prompt_template"): lambda s, b: {"template": s.prompts.template},
        ("POST", "/api/update_prompt_template"): lambda s, b: {"success": s.prompts.set(b["template"])},
        ("POST", "/api/search"): searched,
        ("POST", "/api/generate_prompt"): prompted,
        ("POST", "/api/dify_workflow"): workflow,
        ("POST", "/api/parse_time"): lambda s, b: {"prompt": s.parse_time(b["query"], datetime.now(UTC))},
        ("POST", "/api/classify_query"): lambda s, b: {"success": True, "query": b["query"], "prompt": s.classify_query(b["query"])},
        ("POST", "/api/update_search_weights"): lambda s, b: s.update_search_weights(**b),
        ("POST", "/api/process_logs"): processed(output),
        ("POST", "/api/vectorize_logs"): vectorised,
        ("POST", "/api/analyze_anomalies"): lambda s, b: s.analyze_anomalies(**span(b)),
        ("POST", "/api/analyze_patterns"): lambda s, b: s.analyze_patterns(**span(b)),
        ("POST", "/api/process_and_vectorize"): in_background,
        ("GET", "/api/deduplication/stats"): lambda s, b: {"status": "success", "stats": s.dedup_stats()},
        ("POST", "/api/deduplication/config"): lambda s, b: {"status": "success"} | s.dedup_config(**{k: v for k, v in b.items() if k != "enabled"}),
        ("POST", "/api/deduplication/reset"): lambda s, b: {"status": "success", "stats": s.dedup_stats(reset=True)},
    }


def serve(service: LogService, host: str = "127.0.0.1", port: int = 8000, output: str | None = None) -> ThreadingHTTPServer:
    """A server bound to host and port; call its serve_forever(). output: the folder that processed rows
    are written to; without it nothing is written. Bodies that are no JSON object: 400; unknown paths:
    404; arguments that do not fit: 422; anything else that fails: 500, without its details."""
    known = routes(output)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, value: object) -> None:
            content = json.dumps(value, default=str, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        def run(self) -> None:
            route = known.get((self.command, self.path.split("?")[0]))
            if route is None:
                return self.answer(404, {"status": "error", "message": "unknown path"})
            try:
                length = int(self.headers.get("Content-Length") or 0)
                if length > MOST_BYTES:
                    raise ValueError("too long")
                body = json.loads(self.rfile.read(length) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("not an object")
            except ValueError:
                return self.answer(400, {"status": "error", "message": "the body is not a JSON object"})
            try:
                made = plain(route(service, body))
            except (TypeError, KeyError, ValueError) as wrong:
                log.warning("%s %s: %s", self.command, self.path, wrong)
                return self.answer(422, {"status": "error", "message": "the arguments do not fit"})
            except Exception:
                log.exception("%s %s failed", self.command, self.path)
                return self.answer(500, {"status": "error", "message": "the request failed"})
            return self.answer(200, made)

        do_GET = do_POST = run  # noqa: N815

        def log_message(self, form: str, *values: object) -> None:
            log.info(form, *values)

    return ThreadingHTTPServer((host, port), Handler)

"""The service over HTTP, on a port of its own."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from tailrace.plans import catalog
from tailrace.service import LogService
from tailrace.serving import routes, serve

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("served"))
    server = serve(LogService(spark, catalog.logs(spark, SF)), port=0, output=folder)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def run(path, body=None):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data), timeout=120) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    run.folder = folder
    yield run
    server.shutdown()
    server.server_close()


def test_reading(ask):
    assert ask("/health")[1]["status"] == "ok"
    assert len(ask("/api/services")[1]["services"]) == 8
    assert ask("/api/stats")[1]["total_logs"] == 1000
    assert "{query}" in ask("/api/prompt_template")[1]["template"]
    assert ask("/api/deduplication/stats")[1]["stats"]["total_processed"] == 0


def test_search(ask):
    code, found = ask("/api/search", {"query": "timeoutexception failed", "log_levels": ["ERROR"], "max_results": 4})
    assert code == 200 and len(found["results"]) == 4 and {r["log_level"] for r in found["results"]} == {"ERROR"}
    assert ask("/api/search", {"query": " "})[1]["status"] == "error"
    assert ask("/api/update_search_weights", {"es_weight": 0.25, "vector_weight": 0.5})[1]["new_weights"]["es_weight"] == 0.25
    assert ask("/api/parse_time", {"query": "yesterday"})[1]["prompt"]
    assert ask("/api/deduplication/config", {"enabled": True, "keep_latest_count": 2})[1]["current_config"]["keep_latest_count"] == 2


def test_processing(ask, spark):
    days = {"start_time": "2024-01-01", "end_time": "2024-01-10"}
    code, made = ask("/api/process_logs", days | {"target_index": "rows"})
    assert code == 200 and made["record_count"] == spark.read.parquet(f"{ask.folder}/rows").count()
    stats = ask("/api/deduplication/stats")[1]["stats"]
    assert stats["total_processed"] >= made["record_count"] > 0
    assert ask("/api/deduplication/reset", {})[1]["stats"]["total_processed"] == 0
    assert ask("/api/analyze_patterns", days)[1]["status"] == "success"


def test_what_does_not_fit(ask):
    assert ask("/nowhere")[0] == 404
    assert ask("/api/search", b"no json")[0] == 400
    assert ask("/api/search", [1])[0] == 400
    assert ask("/api/search", {"unknown": 1})[0] == 422
    assert ask("/api/process_logs", {"target_index": "../up"})[0] == 422
    assert len(routes()) == 21

"""Sample rows, the reranking service, similar texts, weights by rule, framework modules, density clusters."""

import difflib
import json
import random
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from tailrace.functions import text
from tailrace.functions.vectors import novelty
from tailrace.operators import models, retrieval
from tailrace.operators.dedup import dbscan
from tailrace.operators.similar import similar_texts
from tailrace.service import LogService
from tailrace.sources import logs
from tailrace.sources.rerank import http_reranker
from tailrace.sources.samples import sample_logs


def test_samples(spark):
    now = datetime(2024, 2, 1)
    rows = sample_logs(spark, now).collect()
    assert len(rows) == 13 and rows == sample_logs(spark, now).collect()
    assert rows[1].log_level == "ERROR" and rows[1].ts == datetime(2024, 1, 31, 23)


def test_similar_texts(spark):
    r = random.Random(4)
    base = ["".join(r.choices("abcde ", k=r.randint(1, 60))) for _ in range(25)]
    near = [t[: len(t) // 2] + r.choice("xyz") + t[len(t) // 2 + 1 :] for t in base]
    rows = list(enumerate([*base, *near, *base[:5], None, "", "x" * 300, "x" * 301]))
    df = spark.createDataFrame(rows, "id long, text string")
    for threshold in (0.5, 0.8, 2 / 3):
        pairs, members = similar_texts(df, threshold, 7)
        first = {}
        for i, t in rows:
            first.setdefault(t or "", i)
        want = {(i, j): difflib.SequenceMatcher(None, a, b).ratio() for a, i in first.items() for b, j in first.items() if i < j and difflib.SequenceMatcher(None, a, b).ratio() >= threshold}
        got = pairs.collect()
        assert {(p.i, p.j): p.similarity for p in got} == want and len(got) == len(want)
        assert {(m.id, m.i) for m in members.collect()} == {(i, first[t or ""]) for i, t in rows}
    assert similar_texts(df.limit(0))[0].count() == 0


def test_reranker(spark):
    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            results = [{"original_result": d["original_result"], "rerank_score": len(d["content"])} for d in asked["documents"]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": results} if asked["query"] == "good" else ["odd"]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    hits = spark.createDataFrame([("a", "one", 1.0, 0.0), ("b", None, 0.5, 0.2)], "id string, message string, es_score double, vector_score double")
    ask = http_reranker(f"http://127.0.0.1:{server.server_port}/", 5)
    assert {tuple(r) for r in ask(hits, "good").collect()} == {("a", 3.0), ("b", 0.0)}
    assert ask(hits, "bad").count() == 0
    server.shutdown()
    server.server_close()
    assert ask(hits, "good").count() == 0


def test_weights_by_rule():
    w = retrieval.Weights(0.3, 0.7, 0.0)
    assert retrieval.heuristic_weights("disk error", w) == (0.5, 0.3, 0.2)
    assert retrieval.heuristic_weights("how does the cache work here", w) == (0.2, 0.6, 0.2)
    assert retrieval.heuristic_weights("show me the cache", w) == (0.3, 0.7, 0.0)
    w.dynamic = False
    assert retrieval.heuristic_weights("disk error", w) == (0.3, 0.7, 0.0)


def test_framework_exceptions(spark):
    df = spark.createDataFrame([("x Volo.Abp.Domain.Entities.EntityNotFoundException: no",), ("System.Exception: y",), (None,)], "t string")
    kind = text.framework_exception(F.col("t"))
    got = [tuple(r) for r in df.select(kind, text.framework_module(kind), text.regex_group(F.col("t"), r"(no|y)$", 1)).collect()]
    assert got == [("Volo.Abp.Domain.Entities.EntityNotFoundException", "Domain", "no"), ("", "", "y"), ("", "", "")]


def test_dbscan_of_copies(spark):
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(10, [0.0, 1.0]), (11, [0.0, 0.0]), (12, [0.0, 0.0]), (13, [-1.0, 0.05]), (14, [-1.0, 0.0])]
    got = dict(map(tuple, dbscan(spark.createDataFrame(rows, "id long, vector array<double>"), 0.92, 2).collect()))
    assert got == {**dict.fromkeys(range(6), 0), 10: -1, 11: -1, 12: -1, 13: 1, 14: 1}
    assert set(dict(map(tuple, dbscan(spark.createDataFrame(rows, "id long, vector array<double>"), 0.92, 3).collect())).values()) == {-1, 0}


def test_density_clusters_of_texts(spark):
    rows = [(str(i), "disk failure node") for i in range(6)] + [(str(i + 10), "login accepted user") for i in range(6)] + [("99", "odd words once")]
    got = {r["_id"]: r.cluster_id for r in models.cluster(spark.createDataFrame(rows, "_id string, template string"), method="dbscan").collect()}
    assert got["99"] == -1 and len({got[str(i)] for i in range(6)}) == 1 and got["0"] != got["10"] and got["10"] != -1


def test_upsert_takes_the_latest_whatever_the_columns_stand(spark):
    rows = [("z", "a", datetime(2024, 1, 1)), ("b", "a", datetime(2024, 1, 3)), ("y", "a", None), ("c", "b", None)]
    new = spark.createDataFrame(rows, "message string, _id string, ts timestamp")
    assert {(r._id, r.message) for r in logs.upsert(None, new).collect()} == {("a", "b"), ("b", "c")}


def test_save_merges_by_id(spark, tmp_path):
    """Runs add to the table and replace rows of the same id, also where an id has moved to another day."""
    path, schema = str(tmp_path / "target"), "_id string, ts timestamp, message string"
    day = lambda n, h=0: datetime(2024, 1, n, h)
    assert logs.save(spark.createDataFrame([("a", day(1), "a1"), ("b", day(1), "b1"), ("c", day(2), "c1")], schema), path) == (3, True)
    assert logs.save(spark.createDataFrame([("c", day(3), "c2"), ("d", day(1), "d1"), ("d", day(1, 5), "d2"), ("b", day(1), "b2")], schema), path) == (3, True)
    got = {(r._id, r.message, str(r.day)) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "a1", "2024-01-01"), ("b", "b2", "2024-01-01"), ("d", "d2", "2024-01-01"), ("c", "c2", "2024-01-03")}
    assert not (tmp_path / "target" / "day=2024-01-02").exists() and not (tmp_path / "target.new").exists() and not (tmp_path / "target.merged").exists()
    assert logs.save(spark.createDataFrame([], schema), path) == (0, True) and spark.read.parquet(path).count() == 4
    plain = str(tmp_path / "plain")
    for n in (1, 2):
        logs.save(spark.createDataFrame([("a", n), (str(n), n)], "_id string, v int"), plain)
    assert {tuple(r) for r in spark.read.parquet(plain).collect()} == {("a", 2), ("1", 1), ("2", 2)}


def test_dedup_settings_reach_ingest(spark, tmp_path):
    rows = [(str(i), datetime(2024, 1, 1, 0, i), "ERROR", f"svc{i % 3}", f"worker {'abcdefgh'[i % 8]} lost its lease on shard") for i in range(24)]
    service = LogService(spark, spark.createDataFrame(rows, "_id string, ts timestamp, log_level string, service_name string, message string"))
    when = ("2024-01-01", "2024-01-02")
    whole = service.process_logs(*when, algorithm="regex", deduplicate=False)["record_count"]
    service.dedup_config(similarity_threshold=0.5, keep_latest_count=2)
    target = str(tmp_path / "t")
    few = service.process_logs(*when, algorithm="regex", target=target)
    assert few["record_count"] == spark.read.parquet(target).count() < whole
    service.dedup_config(keep_latest_count=4)
    assert few["record_count"] < service.process_logs(*when, algorithm="regex")["record_count"] < whole


def test_vectors_of_a_model_of_any_size(spark):
    rows = [(str(i), datetime(2024, 1, 1), "INFO", "s", f"text {i}") for i in range(4)]
    service = LogService(spark, spark.createDataFrame(rows, "_id string, ts timestamp, log_level string, service_name string, message string"), embed=lambda ts: [[float(len(t)), 1.0, 2.0] for t in ts])
    assert {len(r.vector) for r in service.vectorize_logs("2024-01-01", "2024-01-02")["points"].collect()} == {3}


def test_newest_history_counts(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    history = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)], "id long, vector array<double>").repartition(4)
    assert [r.novel for r in novelty(points, history, 0.05, 5).collect()] == [True] and [r.novel for r in novelty(points, history, 0.05, 6).collect()] == [False]

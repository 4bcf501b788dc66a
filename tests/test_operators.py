"""Log operators on small rows, and streams against the same rows as a batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tailrace.operators import aggregates, anomaly, dedup, drain, models, patterns, retrieval
from tailrace.plans import pipelines
from tailrace.sources import logs as sources
from tailrace.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def rows(spark, items):
    data = [(str(i), T0 + dt.timedelta(seconds=s), m, level, service) for i, (s, m, level, service) in enumerate(items)]
    return spark.createDataFrame(data, "_id string, ts timestamp_ntz, message string, log_level string, service_name string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_scan_limits_exactly(spark):
    df = rows(spark, [(i, "m", "INFO", "s") for i in range(120)])
    for n in (0, 99, 120, 500):
        assert sources.scan(df, max_logs=n).count() == min(n, 120)
    assert [r.ts.second for r in sources.scan(df, "2024-01-01 00:00:05", "2024-01-01 00:00:07", fields=["ts"]).collect()] == [5, 6, 7]


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "_id string, v int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("b", 4), ("c", 5)]))
    assert sorted((r._id, r.v) for r in sources.upsert(old, new).collect()) == [("a", 1), ("b", 4), ("c", 5)]


def test_zscore_needs_many_buckets(spark):
    few = rows(spark, [(3600 * i, "e", "ERROR", "s") for i in range(9)])
    assert anomaly.bucket_zscore(few).count() == 0
    steady = [(3600 * i + j, "e", "ERROR", "s") for i in range(60) for j in range(2)] + [(3600 * 59 + 10 + j, "e", "ERROR", "s") for j in range(200)]
    got = anomaly.bucket_zscore(rows(spark, steady), service="service_name").where("anomaly").collect()
    assert [r.bucket.hour for r in got] == [11] and got[0].severity <= 1


def test_sessions_split_beyond_the_gap(spark):
    df = rows(spark, [(0, "a", "ERROR", "s"), (300, "b", "ERROR", "s"), (601, "c", "ERROR", "s"), (0, "x", "ERROR", "t")])
    assert {r.message: r.session for r in patterns.sessions(df, 300, ["service_name"]).collect()} == {"a": 0, "b": 0, "c": 1, "x": 0}


def test_chains(spark):
    items = [(1000 * k + s, m, "ERROR", "s") for k in range(4) for s, m in ((0, "first"), (5, "first"), (10, "second"))]
    got = patterns.chains(rows(spark, items).withColumn("template", F.col("message"))).collect()
    assert [(r.source, r.target, r.support, r.confidence) for r in got] == [("first", "second", 4, 1.0)]
    assert patterns.chains(rows(spark, items[:2])).count() == 0


def test_drain_joins_variants(spark):
    df = rows(spark, [(i, f"user login of {w} from x", "INFO", "s") for i, w in enumerate(("anna", "ben", "cara"))] + [(9, "other thing entirely happened right here now", "INFO", "s")])
    got = drain.mine(df).select("template", "template_id").distinct().orderBy("template_id").collect()
    assert [r.template for r in got] == ["user login of <*> from x", "other thing entirely happened right here now"]


def test_dbscan(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.05]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, [-1.0, 0.02]), (6, [-1.0, 0.0])], "id long, vector array<double>")
    assert {r.id: r.dup_cluster_id for r in dedup.dbscan(p, 0.99).collect()} == {1: 0, 2: 0, 3: 0, 4: -1, 5: 1, 6: 1}
    logs = p.select(F.col("id").cast("string").alias("_id"), "vector", F.timestamp_seconds("id").alias("ts"), (F.col("id") == 1).cast("int").alias("prediction"))
    config = dedup.DedupConfig(similarity_threshold=0.99, keep_latest_count=1)
    assert sorted(r._id for r in dedup.deduplicate(logs, config).collect()) == ["1", "3", "4", "6"]


def test_isolation_forest_finds_outliers():
    import numpy as np

    x = np.r_[np.random.default_rng(0).normal(size=(500, 3)), [[9.0, 9, 9], [-9, 9, -9]]]
    s = models.IsolationForest.fit(x).scores(x)
    assert set(np.argsort(s)[-2:]) == {500, 501}


def test_error_patterns_and_stats(spark):
    df = rows(spark, [(0, "a", "ERROR", "s"), (1, "a", "ERROR", "s"), (2, "b", "FATAL", "s"), (3, "c", "INFO", None)])
    assert [(r.pattern, r.n) for r in aggregates.error_patterns(df).collect()] == [("a", 2), ("b", 1)]
    r = aggregates.stats(df).first()
    assert (r.total_logs, r.error_logs, r.error_ratio, r.vector_count) == (4, 3, 0.75, 0)
    assert aggregates.stats(df.limit(0)).first().error_ratio == 0


def test_merge_keeps_both_sides(spark):
    make = lambda rs: spark.createDataFrame([(i, s, m, "INFO", "s", T0) for i, s, m in rs], "id string, score double, message string, log_level string, service_name string, timestamp timestamp_ntz").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    a, b, r = make([("1", 2.0, "lex"), ("2", 1.0, "both")]), make([("2", 0.5, "other"), ("3", 0.4, "vec")]), make([("2", 0.9, ""), ("9", 0.8, "")])
    got = {x.id: (x.es_score, x.vector_score, x.rerank_score, x.message) for x in retrieval.merge(a, b, r).collect()}
    assert got == {"1": (2.0, 0.0, 0.0, "lex"), "2": (1.0, 0.5, 0.9, "both"), "3": (0.0, 0.4, 0.0, "vec")}
    assert "9" in {x.id for x in retrieval.merge_with_reranked(a, b, r, (0.5, 0.3, 0.2)).collect()}
    ranked = retrieval.ranked(retrieval.merge(a, b, r), "both error", "2024-01-02").collect()
    assert [x["rank"] for x in ranked] == [1, 2, 3] and ranked[0].id in {"1", "2"}


def test_source_weights():
    assert sum(retrieval.source_weights("general", 10.0, 0.5)) == pytest.approx(1)
    assert retrieval.source_weights("keyword_search", None, None) == pytest.approx((0.6, 0.25, 0.15))
    with pytest.raises(ValueError):
        retrieval.Weights().set(es=2)


def test_pipelines(spark):
    df = rows(spark, [(i, f"[ERROR] job {i % 5} failed with Exception: code {i}", "ERROR", f"s{i % 2}") for i in range(60)])
    out = pipelines.extract_and_process(df, algorithm="drain")
    assert out["status"] == "success" and {"template", "template_id", "prediction", "cluster_id", "stack_trace"} <= set(out["logs"].columns)
    made = pipelines.vectorise(df.withColumn("message", F.repeat("message", 40)), size=512)
    assert made.count() > 60 and made.where("id like '%_chunk_1'").count() == 60
    assert pipelines.chunked(df.limit(1)).select("_id").first()._id == "0"


def test_detectors_together(spark):
    df = rows(spark, [(600 * i, f"e{i % 3}", "ERROR" if i % 2 else "INFO", f"s{i % 2}") for i in range(400)]).withColumn("template", F.col("message"))
    found = anomaly.detect_anomalies(df)
    assert found["status"] == "success" and found["anomalies"].where("kind = 'new_error'").count() == 3
    assert anomaly.detect_anomalies(df.where("log_level = 'INFO'"))["status"] == "no_errors"
    assert patterns.analyse(df)["status"] == "success" and patterns.analyse(df.limit(0))["status"] == "no_data"


def test_stream_equals_batch(spark, tmp_path):
    df = rows(spark, [(i * 37 % 5000, f"m{i % 7}", "ERROR" if i % 3 else "INFO", f"s{i % 2}") for i in range(300)])
    for part in range(3):
        df.where(F.col("_id").cast("int") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    jobs.complete(jobs.error_sessions(stream, "60 seconds", "10 days"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, jobs.error_sessions(df, "60 seconds").collect()))
    for _ in range(2):  # a second run finds nothing new
        jobs.incremental(stream, lambda b: b, str(tmp_path / "rows"), str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 300


def test_stateful_streams(spark, tmp_path):
    df = rows(spark, [(i, "m", "ERROR", "s") for i in range(20)]).select(F.col("_id").alias("id"), "service_name", "ts", F.array(F.lit(1.0), (F.col("_id").cast("int") % 2).cast("double")).alias("vector"), (F.col("_id") == "7").cast("int").alias("prediction"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), df.schema)
    q = jobs.novel_only(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1", "7"]

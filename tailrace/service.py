"""The service's entry points as methods over tables: same arguments and keys, DataFrames for rows."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.functions.filters import search_filter
from tailrace.functions.text import clean_text
from tailrace.functions.vectors import DIMENSION, embedder, hashed
from tailrace.operators import aggregates, anomaly, patterns, prompting, retrieval
from tailrace.operators.dedup import DedupConfig
from tailrace.plans import pipelines
from tailrace.schema import FieldMap
from tailrace.sources import logs as sources

log = logging.getLogger(__name__)


class LogService:
    """logs: raw rows; points: (id, vector, metadata) of the vector table, if there is one. embed maps
    texts to vectors; reranker takes hits and the query and gives (id, score)."""

    def __init__(self, spark: SparkSession, logs: DataFrame, points: DataFrame | None = None, fields: FieldMap | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None, reranker: Callable | None = None) -> None:
        self.spark, self.logs, self.points = spark, (fields or FieldMap("ts")).canonical(logs), points
        self.embed, self.reranker = embed, reranker
        self.weights, self.dedup, self.prompts = retrieval.Weights(), DedupConfig(), prompting.Prompts()
        self.known: DataFrame | None = None
        self.dedup_stats(reset=True)

    def health(self) -> dict:
        return {"status": "ok", "vectors": self.points is not None}

    def vector_of(self, query: str) -> list[float]:
        text = self.spark.range(1).select(clean_text(F.lit(query)).alias("t")).first()["t"] or " "
        return self.embed([text])[0] if self.embed else hashed(text)

    def dimension(self) -> int:
        """How many components the model's vectors have."""
        return len(self.embed(["x"])[0]) if self.embed else DIMENSION

    def documents(self) -> DataFrame:
        d = self.logs.select(F.col("_id").alias("id"), "message", "log_level", "service_name", F.col("ts").alias("timestamp"), *(c for c in ("template", "cluster_id") if c in self.logs.columns))
        if self.points is None:
            return d.withColumn("vector", F.lit(None).cast("array<float>"))
        return d.join(self.points.select("id", "vector"), "id", "left")

    def search(self, query: str, services: list[str] | None = None, log_levels: list[str] | None = None, time_range_start: str | None = None, time_range_end: str | None = None, include_vectors: bool = True, max_results: int = 20, filters: dict | None = None, now: datetime | None = None) -> dict:
        began = time.perf_counter()
        both = time_range_start is not None and time_range_end is not None
        spec = search_filter(None, None, services, log_levels, filters) | ({"timestamp": {"$gte": time_range_start, "$lte": time_range_end}} if both else {})
        use = include_vectors and self.points is not None and bool(query.strip())
        found = retrieval.search(self.documents(), query, self.vector_of(query) if use else None, now or datetime.now(UTC).replace(tzinfo=None), spec or None, max_results, None, self.reranker, self.weights)
        log.info("search took %.3f s", time.perf_counter() - began)
        return found | {"search_time": time.perf_counter() - began}

    def generate_prompt(self, query: str, return_search_results: bool = False, **how: object) -> dict:
        intent = prompting.query_intent(query)
        expanded = prompting.expand_query(query, intent)
        found = self.search(expanded, **how)
        if found["status"] != "success":
            return found
        block = prompting.context_block(found["results"]).first()
        out = {"status": "success", "query": query, "expanded_query": expanded, "query_intent": intent, "context_data": block.asDict(True), "prompt": self.prompts.render(query, block["context"])}
        return out | ({"search_results": found["results"]} if return_search_results else {})

    def dify_workflow(self, query: str, include_prompt: bool = True, now: datetime | None = None, **how: object) -> dict:
        now = now or datetime.now(UTC).replace(tzinfo=None)
        how = {"time_range_start": str(now - timedelta(days=7)), "time_range_end": str(now)} | how
        made = self.generate_prompt(query, True, now=now, **how)
        out = {"query": query, "search_results": made.get("search_results"), "meta": {"total": made["search_results"].count() if made.get("search_results") is not None else 0}}
        return out | ({"prompt": made.get("prompt"), "context_data": made.get("context_data")} if include_prompt else {})

    def extract(self, start_time: str | None = None, end_time: str | None = None, max_logs: int | None = 10_000, query_filter: dict | None = None) -> DataFrame:
        return sources.scan(self.logs, start_time, end_time, query_filter, None, max_logs)

    def process_logs(self, start_time: str, end_time: str, max_logs: int = 10_000, query_filter: dict | None = None, target: str | None = None, algorithm: str = "drain", deduplicate: bool = True) -> dict:
        """Near copies go by the settings of dedup_config(); target is merged into by id."""
        rows = self.extract(start_time, end_time, max_logs, query_filter)
        out = pipelines.extract_and_process(rows, algorithm=algorithm, vector_dedup=self.dedup if deduplicate else None, embed=self.embed, dimension=self.dimension())
        n = sources.save(out["logs"], target)[0] if target else out["logs"].count()
        seen = rows.count()
        self.processed, self.removed = self.processed + seen, self.removed + seen - n
        return out | {"record_count": n}

    def vectorize_logs(self, start_time: str, end_time: str, max_logs: int = 10_000, query_filter: dict | None = None, content_column: str = "message") -> dict:
        new = pipelines.vectorise(self.extract(start_time, end_time, max_logs, query_filter), content_column, embedder(self.embed, self.dimension()))
        self.points = sources.add_vectors(self.points, new, self.dimension())
        return {"status": "success", "points": self.points}

    def analyze_anomalies(self, start_time: str, end_time: str, max_logs: int = 10_000, query_filter: dict | None = None, services: list[str] | None = None, log_levels: list[str] | None = None) -> dict:
        found = anomaly.detect_anomalies(self.extract(start_time, end_time, max_logs, query_filter), services, log_levels, known=self.known)
        self.known = found["known"]
        return found

    def analyze_patterns(self, start_time: str, end_time: str, max_logs: int = 10_000, query_filter: dict | None = None, services: list[str] | None = None, log_levels: list[str] | None = None) -> dict:
        return patterns.analyse(self.extract(start_time, end_time, max_logs, query_filter), services, log_levels)

    def process_and_vectorize(self, time_window_hours: int = 24, now: datetime | None = None, prefilter: bool = True, time_window_minutes: int = 30, max_logs: int = 10_000) -> dict:
        end = now or datetime.now(UTC).replace(tzinfo=None)
        rows = self.extract(str(end - timedelta(hours=time_window_hours)), str(end), max_logs)
        if rows.isEmpty():
            return {"status": "no_new_data"}
        out = pipelines.extract_and_process(rows, prefilter, time_window_minutes, vector_dedup=self.dedup, embed=self.embed, dimension=self.dimension())
        return {"status": "success", "logs": out["logs"], "points": pipelines.vectorise(out["logs"], embed=embedder(self.embed, self.dimension()))}

    def update_search_weights(self, es_weight: float | None = None, vector_weight: float | None = None, weights_config: str | dict | None = None, disable_dynamic_weights: bool = True) -> dict:
        given = json.loads(weights_config) if isinstance(weights_config, str) else weights_config or {}
        old = {"es_weight": self.weights.es, "vector_weight": self.weights.vector, "rerank_weight": self.weights.rerank}
        new = self.weights.set(given.get("es_weight", es_weight), given.get("vector_weight", vector_weight), not disable_dynamic_weights)
        return {"old_weights": old, "new_weights": new} | ({"analysis": given["analysis"]} if "analysis" in given else {})

    def dedup_config(self, **changes: float) -> dict:
        return {"current_config": self.dedup.update(**changes)}

    def dedup_stats(self, reset: bool = False) -> dict:
        """How many rows process_logs has seen and removed as duplicates so far."""
        if reset:
            self.processed = self.removed = 0
        return {"total_processed": self.processed, "total_removed": self.removed, "removal_rate": self.removed / self.processed if self.processed else 0.0}

    def classify_query(self, query: str) -> str:
        return prompting.classify_prompt(query)

    def parse_time(self, query: str, now: datetime) -> str:
        return prompting.time_prompt(query, now.isoformat())

    def services(self) -> DataFrame:
        return aggregates.top_terms(self.logs, "service_name", 100)

    def log_levels(self) -> DataFrame:
        return aggregates.top_terms(self.logs, "log_level", 20)

    def stats(self) -> DataFrame:
        return aggregates.stats(self.logs, self.points)

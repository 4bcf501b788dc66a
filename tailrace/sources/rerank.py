"""A reranking service as a source of scores for the hits of a hybrid search."""

from __future__ import annotations

import json
import logging
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def http_reranker(url: str, seconds: float = 30, most: int = 30) -> Callable[[DataFrame, str], DataFrame]:
    """A reranker that posts the query and at most `most` hits (id, message, es_score, vector_score) to
    url and takes (id, score) from results[].original_result.id and results[].rerank_score. A service
    that fails, is late or answers something else gives no scores; the search goes on without them."""

    def rerank(hits: DataFrame, query: str) -> DataFrame:
        rows = hits.select("id", "message", "es_score", "vector_score").limit(most).collect()
        documents = [{"id": r["id"], "content": r["message"] or "", "es_score": r["es_score"], "vector_score": r["vector_score"], "original_result": {"id": r["id"]}} for r in rows]
        body = json.dumps({"query": query, "documents": documents, "top_k": len(documents)}).encode()
        scores: dict = {}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=seconds) as answer:
                for d in json.load(answer).get("results", []) if answer.status == 200 else []:
                    scores[d["original_result"]["id"]] = float(d.get("rerank_score", 0.0))
        except (urllib.error.URLError, TimeoutError, ValueError, KeyError, TypeError, AttributeError) as failed:
            log.warning("no scores from the reranker: %s", failed)
            scores = {}
        kind = dict(hits.dtypes)["id"]
        return hits.sparkSession.createDataFrame(list(scores.items()), f"id {kind}, score double")

    return rerank

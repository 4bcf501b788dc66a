"""Ingest and vector pipelines as chains of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.checkpoints import checkpointed
from tailrace.functions import text
from tailrace.functions.filters import is_error
from tailrace.functions.masks import first_in_bucket
from tailrace.functions.vectors import DIMENSION, embedder
from tailrace.operators.aggregates import error_patterns
from tailrace.operators.dedup import DedupConfig, deduplicate
from tailrace.operators.drain import parse_logs
from tailrace.operators.models import cluster, predict_anomalies
from tailrace.sources.logs import payload


def preprocess(logs: DataFrame, keep_level: bool = False) -> DataFrame:
    """logs with the level that the message names (unless keep_level), extracted_timestamp,
    stack_trace and cleaned_message; null messages become empty."""
    m = F.coalesce("message", F.lit(""))
    out = logs.withColumn("message", m)
    new = {"stack_trace": text.stack_trace(F.col("message")), "cleaned_message": text.clean_message(F.col("message"))}
    if not keep_level or "log_level" not in logs.columns:
        new["log_level"] = text.level_of(F.col("message"))
    if "timestamp" not in logs.columns:
        new["extracted_timestamp"] = text.time_of(F.col("message"))
    return out.withColumns(new)


def normalise_exceptions(logs: DataFrame) -> DataFrame:
    return logs.withColumns(text.exception_columns(F.col("message")))


def structured(logs: DataFrame) -> DataFrame:
    """logs with json and kv maps of what their messages hold."""
    return logs.withColumn("json", text.find_json("message")).withColumn("kv", text.key_values(F.col("message")))


def extract_and_process(logs: DataFrame, prefilter: bool = True, minutes: int = 30, algorithm: str = "drain", vector_dedup: DedupConfig | None = None, embed: Callable | None = None, dimension: int = DIMENSION) -> dict:
    """Clean, mask, drop duplicates - by bucket, and with vector_dedup near copies by vector -, mine
    templates, flag anomalies, cluster, count error patterns: status, logs, error_patterns."""
    out = normalise_exceptions(preprocess(logs))
    out = first_in_bucket(out, minutes) if prefilter else out
    if vector_dedup:
        # vectors are made once; what is left is written down for the steps that read it several times
        out = checkpointed(deduplicate(checkpointed(out.withColumn("vector", embedder(embed, dimension)(F.col("message")))), vector_dedup).drop("vector"))
    out = cluster(predict_anomalies(parse_logs(out, algorithm)), "template")
    if out.isEmpty():
        return {"status": "no_data", "logs": out, "error_patterns": None}
    return {"status": "success", "logs": out, "error_patterns": error_patterns(out)}


def chunked(logs: DataFrame, content: str = "message", size: int = 512, overlap: int = 0) -> DataFrame:
    """One row for each piece of the text: chunk, chunk_index, total_chunks, and _id with its number
    where there are several."""
    pieces = logs.withColumn("__pieces", text.chunks(F.col(content), size, overlap)).withColumn("total_chunks", F.size("__pieces"))
    rows = pieces.select("*", F.posexplode_outer("__pieces").alias("chunk_index", "chunk")).drop("__pieces")
    name = F.when(F.col("total_chunks") > 1, F.concat("_id", F.lit("_chunk_"), F.col("chunk_index").cast("string"))).otherwise(F.col("_id"))
    return rows.withColumn("_id", name).withColumn(content, F.coalesce("chunk", F.lit(""))).drop("chunk")


def vectorise(logs: DataFrame, content: str = "message", embed: Callable[[Column], Column] | None = None, dedup: DedupConfig | None = None, size: int = 512) -> DataFrame:
    """(id, vector, metadata) points of the logs' texts, long ones in pieces."""
    rows = logs.withColumn(content, F.coalesce(content, F.lit("")))
    rows = rows if "_id" in rows.columns else rows.withColumn("_id", F.md5(F.col(content).cast("binary")))
    embed = embed or embedder()
    if dedup:
        rows = deduplicate(rows.withColumn("vector", embed(F.col(content))), dedup).drop("vector")
    return payload(chunked(rows, content, size).withColumn("vector", embed(F.col(content))), content)


def by_service(logs: DataFrame, service: str, **how: object) -> DataFrame:
    return vectorise(logs.where(F.col("service_name") == service), **how)


def cluster_templates(logs: DataFrame, **how: object) -> DataFrame:
    """Points of one row for each template: the first."""
    one = logs.groupBy("template").agg(F.min_by(F.struct(*logs.columns), F.struct("ts", "_id")).alias("r")).select("r.*")
    return vectorise(one, content="template", **how)


def error_stacks(logs: DataFrame, **how: object) -> DataFrame:
    """Points of the stack traces of errors."""
    return vectorise(logs.where(is_error(logs.columns) & F.col("stack_trace").isNotNull() & (F.col("stack_trace") != "")), content="stack_trace", **how)

"""Structured Streaming: incremental ingest, windows with watermarks, sessions, stateful duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tailrace.functions.filters import is_error
from tailrace.functions.masks import masked

LATE = "10 minutes"


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; the checkpoint takes the place of a watermark file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def incremental(stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Processes all there is, batch by batch, each written once whatever is repeated after a failure;
    a run without new files writes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete(result: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs an aggregation over all there is; the table at target is its result after each batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(logs: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """(window_start, log_level, n) with late rows up to the watermark; slide makes windows overlap."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = logs.withWatermark("ts", late) if logs.isStreaming else logs
    return counted.groupBy(w.alias("w"), "log_level").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "log_level", "n")


def error_sessions(logs: DataFrame, gap: str = "300 seconds", late: str = LATE) -> DataFrame:
    """(service_name, start, end, n): runs of errors whose gaps are at most `gap`."""
    errors = logs.where(is_error(logs.columns))
    errors = errors.withWatermark("ts", late) if logs.isStreaming else errors
    s = errors.groupBy(F.session_window("ts", gap).alias("w"), "service_name").agg(F.count("*").alias("n"))
    return s.select("service_name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_messages(logs: DataFrame, late: str = LATE) -> DataFrame:
    """One row for each service and masked message within the watermark."""
    keyed = logs.withColumn("mask", masked(F.col("message"))).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["service_name", "mask"])


def novel_only(points: DataFrame, least: float = 0.05, most: int = 10_000, hours: int = 24) -> DataFrame:
    """points(service_name, id, ts, vector, prediction) that differ from all earlier ones of their
    service by at least this cosine distance, and all anomalies. The state is a ring of `most`
    vectors; those older than `hours` before the newest row go."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        times, ring = ([], []) if not state.exists else (list(state.get[0]), [np.array(v) for v in state.get[1]])
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "id"])
            kept = []
            for row in pdf.itertuples():
                v = np.asarray(row.vector, dtype=float)
                v = v / max(np.linalg.norm(v), 1e-12)
                new = not ring or float(1 - (np.stack(ring) @ v).max()) > least
                if new:
                    ring.append(v)
                    times.append(int(row.ts.timestamp()))
                kept.append(new or row.prediction == 1)
            edge = int(pdf.ts.max().timestamp()) - hours * 3600
            live = [i for i, t in enumerate(times) if t >= edge][-most:]
            times, ring = [times[i] for i in live], [ring[i] for i in live]
            yield pdf.loc[kept, ["id", "service_name", "ts"]]
        state.update((times, [v.tolist() for v in ring]))

    return points.groupBy("service_name").applyInPandasWithState(keep, "id string, service_name string, ts timestamp", "times array<long>, ring array<array<double>>", "append", "NoTimeout")


def first_seen(logs: DataFrame, kind: str = "template") -> DataFrame:
    """(service_name, kind, first_ts) the first time that a service shows an error type; known types
    are kept as state by service."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        known = set(state.get[0]) if state.exists else set()
        for pdf in frames:
            first = pdf[~pdf[kind].isin(known)].groupby(kind, as_index=False)["ts"].min()
            known |= set(first[kind])
            yield pd.DataFrame({"service_name": key[0], kind: first[kind], "first_ts": first["ts"]})
        state.update((sorted(known),))

    errors = logs.where(is_error(logs.columns)).select("service_name", kind, "ts")
    return errors.groupBy("service_name").applyInPandasWithState(keep, f"service_name string, {kind} string, first_ts timestamp", "known array<string>", "append", "NoTimeout")

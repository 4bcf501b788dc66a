"""Time-series anomalies of error rows. Every detector works on all services at once: the service is
part of the partition keys, `service` may be None for one series over all."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.filters import is_error
from tailrace.functions.times import floor_to
from tailrace.operators.models import IsolationForest

#: Rows and buckets that a series needs.
LEAST = 10


def bucket_zscore(errors: DataFrame, seconds: int = 3600, sensitivity: float = 0.95, service: str | None = None, exclude_current: bool = False) -> DataFrame:
    """(service, bucket, n, mean, std, z, severity, anomaly) of every bucket that has errors.

    The mean and sample deviation are those of the last w = max(3, buckets // 5) existing buckets, the
    current one included unless it is excluded; where there are fewer, of the whole series. A bucket
    is abnormal if |z| > 3 * sensitivity. Since the current point counts, |z| cannot exceed
    (w - 1) / sqrt(w). Only the counts are windowed, never the rows.
    """
    by = [F.col(service)] if service else []
    counts = errors.withColumn("bucket", floor_to(F.col("ts"), seconds)).groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bucket")
    size = F.count("*").over(whole)
    width = F.greatest(F.lit(3), F.floor(size / 5))
    at = F.row_number().over(order)
    sums = order.rowsBetween(Window.unboundedPreceding, 0)
    c = counts.select(*by, "bucket", "n", size.alias("size"), width.alias("w"), at.alias("at"), F.sum("n").over(whole).alias("rows"), F.avg("n").over(whole).alias("all_mean"), F.stddev_samp("n").over(whole).alias("all_std"), F.sum("n").over(sums).alias("s1"), F.sum(F.col("n") * F.col("n")).over(sums).alias("s2"))
    # a frame's width may not depend on the data: differences of running sums do
    before = c.select(*by, (F.col("at") + F.col("w")).alias("at"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    c = c.join(before, [*([service] if service else []), "at"], "left")
    w = F.col("w")
    s1, s2 = F.col("s1") - F.coalesce("b1", F.lit(0)), F.col("s2") - F.coalesce("b2", F.lit(0))
    if exclude_current:
        s1, s2, w = s1 - F.col("n"), s2 - F.col("n") * F.col("n"), w - 1
    full = F.col("at") >= F.col("w")
    variance = F.greatest(F.lit(0.0), (s2 * w - s1 * s1) / (w * (w - 1)))
    c = c.withColumn("mean", F.when(full, s1 / w).otherwise(F.col("all_mean"))).withColumn("std", F.when(full, F.sqrt(variance)).otherwise(F.col("all_std")))
    z = (F.col("n") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1.0))
    limit = 3.0 * sensitivity
    c = c.withColumn("z", z).where((F.col("rows") >= LEAST) & (F.col("size") >= LEAST))
    return c.select(*by, "bucket", "n", "mean", "std", "z", F.least(F.lit(1.0), F.abs("z") / (2 * limit)).alias("severity"), (F.abs("z") > limit).alias("anomaly"))


def volume_anomalies(errors: DataFrame, column: str, seconds: int = 3600, sensitivity: float = 0.95, service: str | None = None, seed: int = 42) -> DataFrame:
    """(service, bucket, n, score, severity, anomaly): buckets whose counts by type are isolated by a
    forest, on scaled counts throughout. Series of fewer than ten buckets give nothing. Every type of a
    series counts, null as a type of its own; n is all of the bucket's rows. Only bucket counts go to
    a series' task, which holds a number for each of its buckets and types."""
    name = service or "__all"
    rows = errors if service else errors.withColumn(name, F.lit("all"))
    counts = rows.withColumn("bucket", floor_to(F.col("ts"), seconds)).groupBy(name, "bucket", F.col(column).alias("__type")).agg(F.count("*").alias("__n"))

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        at, buckets = pd.factorize(pdf["bucket"], sort=True)
        if len(buckets) < LEAST:
            return pd.DataFrame({name: [], "bucket": [], "n": [], "score": [], "severity": [], "anomaly": []})
        # the most frequent type first, as the forest draws columns by place
        totals = pdf.groupby("__type", dropna=False)["__n"].sum().reset_index().sort_values(["__n", "__type"], ascending=[False, True])
        place = {None if pd.isna(t) else t: i for i, t in enumerate(totals["__type"])}
        x = np.zeros((len(buckets), len(place)))
        x[at, [place[None if pd.isna(t) else t] for t in pdf["__type"]]] = pdf["__n"]
        scaled = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        score = 0.5 - IsolationForest.fit(scaled, seed=seed).scores(scaled)
        limit = np.quantile(score, 1 - sensitivity)
        return pd.DataFrame({name: pdf[name].iloc[0], "bucket": buckets, "n": x.sum(axis=1).astype(int), "score": score, "severity": np.clip(-score / 0.5, 0, 1), "anomaly": score <= limit})

    out = counts.groupBy(name).applyInPandas(detect, f"{name} string, bucket timestamp, n long, score double, severity double, anomaly boolean")
    return out if service else out.drop(name)


def new_error_types(errors: DataFrame, known: DataFrame | None, kind: str = "template", scope: list[str] | None = None) -> DataFrame:
    """Types that the state table `known` lacks, within the scope's columns: first time, count, first
    message, severity 0.7. The state is to be extended by known_types()."""
    keys = [*(scope or []), kind]
    fresh = errors if known is None else errors.join(known.select(*keys).distinct(), keys, "left_anti")
    found = fresh.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"), F.min_by("message", F.struct("ts", "_id")).alias("example"))
    return found.withColumn("severity", F.lit(0.7))


def known_types(errors: DataFrame, known: DataFrame | None, kind: str = "template", scope: list[str] | None = None) -> DataFrame:
    keys = [*(scope or []), kind]
    now = errors.select(*keys).distinct()
    return now if known is None else known.select(*keys).unionByName(now).distinct()


def error_combinations(errors: DataFrame, kind: str = "template", seconds: int = 3600, by: str | None = None) -> DataFrame:
    """Buckets of at least three errors of at least three types whose three most frequent ones are
    about equally frequent (largest over smallest below two), severity 0.6."""
    keys = [*([by] if by else []), "bucket"]
    counts = errors.withColumn("bucket", floor_to(F.col("ts"), seconds)).groupBy(*keys, kind).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), kind))
    top = F.col("rank") <= 3
    found = counts.withColumn("rank", rank).groupBy(*keys).agg(
        F.sum("n").alias("n_errors"), F.count("*").alias("n_types"), F.max(F.when(top, F.col("n"))).alias("most"), F.min(F.when(top, F.col("n"))).alias("least"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(top, F.struct(F.col("rank"), F.col(kind).alias("k"))))), lambda x: x["k"]), ",").alias("types"),
    )
    return found.where((F.col("n_errors") >= 3) & (F.col("n_types") >= 3) & (F.col("most") / F.col("least") < 2)).withColumn("severity", F.lit(0.6))


def labelled(found: DataFrame, kind: str, ts: str, details: list[str]) -> DataFrame:
    """A detector's rows in the common form (kind, service_name, ts, severity, details)."""
    service = F.col("service_name") if "service_name" in found.columns else F.lit(None).cast("string")
    pairs = [x for c in details for x in (F.lit(c), F.col(c).cast("string"))]
    return found.select(F.lit(kind).alias("kind"), service.alias("service_name"), F.col(ts).alias("ts"), "severity", F.create_map(*pairs).alias("details"))


def detect_anomalies(logs: DataFrame, services: list[str] | None = None, levels: list[str] | None = None, seconds: int = 3600, sensitivity: float = 0.95, by_service: bool = True, known: DataFrame | None = None) -> dict:
    """All detectors over the errors of the chosen services and levels: status, anomalies (a DataFrame
    in the common form), known (the new state)."""
    logs = logs.where(F.col("service_name").isin(services)) if services else logs
    logs = logs.where(F.col("log_level").isin(levels)) if levels else logs
    errors = logs.where(is_error(logs.columns))
    service: str | None = "service_name" if by_service else None
    errors = errors.where("service_name is not null") if by_service else errors
    counts = logs.agg(F.count("*").alias("n"), F.count_if(is_error(logs.columns)).alias("errors")).first()
    if not counts["n"] or not counts["errors"]:
        return {"status": "no_errors" if counts["n"] else "no_data", "anomalies": None, "known": known}
    kind = next((c for c in ("template", "template_key") if c in logs.columns), None)
    parts = [labelled(bucket_zscore(errors, seconds, sensitivity, service).where("anomaly"), "time_series", "bucket", ["n", "mean", "std", "z"])]
    parts.append(labelled(volume_anomalies(errors, kind or "log_level", seconds, sensitivity, service).where("anomaly"), "volume", "bucket", ["n", "score"]))
    if kind:
        parts.append(labelled(new_error_types(errors, known, kind, ["service_name"] if service else None), "new_error", "first_ts", [kind, "n", "example"]))
        parts.append(labelled(error_combinations(errors, kind, seconds, service), "combination", "bucket", ["n_errors", "types"]))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return {"status": "success", "anomalies": found, "known": known_types(errors, known, kind, ["service_name"] if service else None) if kind else known}


def within(ts: Column, now: datetime, hours: int) -> Column:
    return ts >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")

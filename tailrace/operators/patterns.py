"""Patterns over error rows: sessions and chains, time patterns, related errors, service dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.filters import is_error
from tailrace.functions.text import keywords
from tailrace.functions.times import calendar, floor_to, seconds_between


def error_key(columns: list[str]) -> Column:
    """What an error is known by: its template, else its cluster, else three keywords."""
    for c in ("template", "template_key", "cluster_id"):
        if c in columns:
            return F.col(c).cast("string")
    return F.array_join(keywords(F.col("message"), most=3), "_")


def sessions(rows: DataFrame, gap_seconds: float, by: list[str] | None = None) -> DataFrame:
    """rows with session: a new one begins where more than the gap lies behind the row before. Rows
    are ordered inside each key; without keys they are ordered as a whole, for rows already reduced."""
    order = Window.partitionBy(*(by or [])).orderBy("ts", "_id")
    starts = F.coalesce((seconds_between(F.col("ts"), F.lag("ts").over(order)) > gap_seconds).cast("int"), F.lit(0))
    return rows.withColumn("__start", starts).withColumn("session", F.sum("__start").over(order)).drop("__start")


def chains(errors: DataFrame, gap_seconds: float = 300, support: int = 3, confidence: float = 0.6, by: list[str] | None = None, most: int | None = 20) -> DataFrame:
    """(source, target, support, confidence): errors that follow one another in sessions, equal
    neighbours counted once; confidence is the support over the source's occurrences. Of each key:
    nothing with fewer than three rows or sessions."""
    by = by or []
    keyed = sessions(errors.withColumn("key", error_key(errors.columns)).where("key is not null"), gap_seconds, by)
    inside = Window.partitionBy(*by, "session").orderBy("ts", "_id")
    once = keyed.withColumn("__before", F.lag("key").over(inside)).where("__before is null or __before <> key")
    pairs = once.withColumn("target", F.lead("key").over(inside))
    enough = keyed.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("session").alias("s")).where("n >= 3 and s >= 3")
    counts = once.groupBy(*by, "key").agg(F.count("*").alias("occurrences"))
    found = pairs.where("target is not null").groupBy(*by, "key", "target").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    found = found.join(counts, [*by, "key"])
    found = found.join(enough.select(*by), by, "left_semi") if by else found.join(F.broadcast(enough.select(F.lit(1).alias("__one"))), F.lit(True), "left_semi")
    found = found.withColumn("confidence", F.col("support") / F.col("occurrences")).where(F.col("confidence") >= confidence)
    found = found.select(*by, F.col("key").alias("source"), "target", "support", "confidence")
    return found if most is None else found.orderBy(F.col("confidence").desc(), F.col("support").desc(), *by, "source", "target").limit(most)


def chain_graph(found: DataFrame) -> DataFrame:
    """The chain graph's edges (src, dst, weight)."""
    return found.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("support").alias("weight"))


def hour_concentration(errors: DataFrame, kind: str, share: float = 0.3, least: int = 3) -> DataFrame:
    """(kind, hour, n, share): hours with at least this share of a kind's rows."""
    parts = calendar(F.col("ts"))
    hourly = errors.groupBy(kind, parts["hour"].alias("hour")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(kind))
    return hourly.withColumn("share", F.col("n") / total).where((F.col("share") >= share) & (F.col("n") >= least))


def day_parts(errors: DataFrame, kind: str, least: int = 3) -> DataFrame:
    """(kind, n, business_share, weekend_share, weekend_factor, pattern): 'non_business' if at least 0.7
    lie outside business hours, else 'business' if 0.7 lie inside; 'weekend' if the weekend's share is
    at least 1.5 of what two days of seven would have."""
    parts = calendar(F.col("ts"))
    c = errors.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(parts["business"]).alias("b"), F.count_if(parts["weekend"]).alias("w")).where(F.col("n") >= least)
    c = c.select(kind, "n", (F.col("b") / F.col("n")).alias("business_share"), (F.col("w") / F.col("n")).alias("weekend_share"))
    c = c.withColumn("weekend_factor", F.col("weekend_share") * 3.5)
    hours = F.when(1 - F.col("business_share") >= 0.7, "non_business").when(F.col("business_share") >= 0.7, "business")
    return c.withColumn("hours", hours).withColumn("weekend", F.col("weekend_factor") >= 1.5)


def high_days(errors: DataFrame, kind: str, deviations: float = 2.0) -> DataFrame:
    """(day, n, mean, std, confidence, top): days with more errors than the mean and so many sample
    deviations, at least three days given; with the three most frequent kinds."""
    counts = errors.groupBy(F.to_date("ts").alias("day"), kind).agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.col("c").desc(), kind))
    ranked = counts.withColumn("rank", rank)
    days = ranked.groupBy("day").agg(F.sum("c").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.col(kind).alias("k"))))), lambda x: x["k"]), ",").alias("top"))
    over = Window.partitionBy()
    days = days.select("day", "n", "top", F.avg("n").over(over).alias("mean"), F.stddev_samp("n").over(over).alias("std"), F.count("*").over(over).alias("days"))
    high = days.where((F.col("days") >= 3) & (F.col("n") > F.col("mean") + deviations * F.col("std")))
    return high.select("day", "n", "mean", "std", ((F.col("n") - F.col("mean")) / (F.col("std") + 1)).alias("confidence"), "top")


def related(errors: DataFrame, target: str, seconds: int = 300, kind: str = "template") -> DataFrame:
    """(kind, n, before, after, relation): errors within so many seconds of an occurrence of the target,
    the target left out. An interval join by equality: rows go to their time bucket, occurrences to
    theirs and the two beside it, then the exact bound applies."""
    at = F.floor(F.unix_micros("ts") / (seconds * 1_000_000))
    hits = errors.where(F.col(kind) == target).select(F.col("ts").alias("hit_ts"), F.explode(F.sequence(at - 1, at + 1)).alias("slot"))
    others = errors.where(F.col(kind) != target).select(kind, "ts", at.alias("slot"))
    d = seconds_between(F.col("ts"), F.col("hit_ts"))
    near = others.join(hits, "slot").where(F.abs(d) <= seconds)
    c = near.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(d < 0).alias("before"), F.count_if(d > 0).alias("after"))
    relation = F.when(F.col("before") > 2 * F.col("after"), "precedes").when(F.col("after") > 2 * F.col("before"), "follows").otherwise("co-occurrence")
    return c.withColumn("relation", relation)


def service_dependencies(logs: DataFrame, seconds: int = 300, support: int = 3, most: int | None = 20) -> DataFrame:
    """(source, target, support, buckets): services seen in the same time buckets, a bucket with an error
    counting twice; the source is the one that was seen first. Only distinct (bucket, service) rows
    are joined."""
    seen = logs.where("service_name is not null").withColumn("bucket", floor_to(F.col("ts"), seconds))
    cells = seen.groupBy("bucket", "service_name").agg(F.max(is_error(logs.columns).cast("int")).alias("error"), F.min("ts").alias("first"))
    first = cells.groupBy("service_name").agg(F.min("first").alias("first"))
    bad = cells.groupBy("bucket").agg((1 + F.max("error")).alias("weight"))
    a = cells.join(bad, "bucket").select("bucket", "weight", F.col("service_name").alias("s1"))
    b = cells.select("bucket", F.col("service_name").alias("s2"))
    pairs = a.join(b, "bucket").where("s1 < s2").groupBy("s1", "s2").agg(F.sum("weight").alias("support"), F.count("*").alias("buckets")).where(F.col("support") >= support)
    f1, f2 = (first.select(F.col("service_name").alias(f"s{i}"), F.col("first").alias(f"f{i}")) for i in (1, 2))
    pairs = pairs.join(f1, "s1").join(f2, "s2")
    forward = F.col("f1") <= F.col("f2")
    out = pairs.select(F.when(forward, F.col("s1")).otherwise(F.col("s2")).alias("source"), F.when(forward, F.col("s2")).otherwise(F.col("s1")).alias("target"), "support", "buckets")
    return out if most is None else out.orderBy(F.col("support").desc(), "source", "target").limit(most)


def analyse(logs: DataFrame, services: list[str] | None = None, levels: list[str] | None = None, window_seconds: int = 300) -> dict:
    """All patterns of the chosen rows: status, and a DataFrame each of chains, hours, day parts, days
    and dependencies."""
    logs = logs.where(F.col("service_name").isin(services)) if services else logs
    logs = logs.where(F.col("log_level").isin(levels)) if levels else logs
    errors = logs.where(is_error(logs.columns))
    n = errors.count()
    if not n:
        return {"status": "no_data" if logs.isEmpty() else "no_errors"}
    keyed = errors.withColumn("__kind", error_key(errors.columns))
    out = {"status": "success" if n >= 3 else "insufficient_data", "chains": chains(errors, window_seconds, by=["service_name"]), "hours": hour_concentration(keyed, "__kind"), "day_parts": day_parts(keyed, "__kind"), "high_days": high_days(keyed, "__kind")}
    n_services = logs.agg(F.count_distinct("service_name").alias("n")).first()["n"] if "service_name" in logs.columns else 0
    out["dependency_status"] = "missing_service_column" if "service_name" not in logs.columns else "single_service" if n_services < 2 else "insufficient_data" if n < 15 else "success"
    if out["dependency_status"] == "success":
        out["dependencies"] = service_dependencies(logs, window_seconds)
    return out

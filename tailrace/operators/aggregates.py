"""Counts, buckets, top terms and crosstabs over log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.filters import is_error
from tailrace.functions.text import plain_words
from tailrace.functions.times import calendar, floor_to
from tailrace.schema import ERROR_LEVELS


def top_terms(logs: DataFrame, column: str, n: int) -> DataFrame:
    """(column, n) of the most frequent values, ties by value."""
    return logs.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def stats(logs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row: total, errors, their ratio (0 if empty) and the number of vectors."""
    errors = F.count_if(F.col("log_level").isin(*ERROR_LEVELS))
    ratio = F.when(F.count("*") == 0, 0.0).otherwise(errors / F.count("*"))
    one = logs.agg(F.count("*").alias("total_logs"), errors.alias("error_logs"), ratio.alias("error_ratio"))
    n = vectors.agg(F.count("*").alias("vector_count")) if vectors is not None else None
    return one.withColumn("vector_count", F.lit(0).cast("long")) if n is None else one.join(F.broadcast(n), F.lit(True))


def error_patterns(logs: DataFrame, keys: list[str] | None = None, examples: bool = True) -> DataFrame:
    """Errors counted by template, template_id and cluster_id, as far as there; else by their first
    fifty characters. With the first message and stack trace of each, in one aggregation."""
    errors = logs.where(is_error(logs.columns))
    keys = keys or [c for c in ("template", "template_id", "cluster_id") if c in logs.columns]
    if not keys:
        errors, keys = errors.withColumn("pattern", F.substring("message", 1, 50)), ["pattern"]
    first = F.struct("ts", "_id")
    extra = [F.min_by("message", first).alias("example")] if examples else []
    if examples and "stack_trace" in logs.columns:
        stack = F.min_by(F.nullif("stack_trace", F.lit("")), F.when(F.col("stack_trace") != "", first))
        extra.append(F.when(F.length(stack) > 1000, F.concat(F.substring(stack, 1, 1000), F.lit("..."))).otherwise(stack).alias("stack_trace"))
    return errors.groupBy(*keys).agg(F.count("*").alias("n"), *extra).orderBy(F.col("n").desc(), *keys)


def per_bucket(logs: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """(bucket, keys..., n); buckets without rows are absent."""
    return logs.withColumn("bucket", floor_to(F.col("ts"), seconds)).groupBy("bucket", *keys).agg(F.count("*").alias("n"))


def pivoted(logs: DataFrame, seconds: int, column: str, values: list[str]) -> DataFrame:
    """One column of counts for each value, 0 where it does not occur."""
    return per_bucket(logs, seconds, column).groupBy("bucket").pivot(column, values).agg(F.sum("n")).na.fill(0)


def hour_by_weekday(logs: DataFrame) -> DataFrame:
    """The heat-map's numbers: rows by hour, a column for each weekday from Monday."""
    days = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    parts = calendar(F.col("ts"))
    name = F.element_at(F.array(*map(F.lit, days)), parts["weekday"] + 1)
    return logs.select(parts["hour"].alias("hour"), name.alias("day")).groupBy("hour").pivot("day", days).count().na.fill(0)


def daily(logs: DataFrame) -> DataFrame:
    """(day, n, mean, std): rows a day, with mean and sample deviation over the days."""
    days = logs.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    over = Window.partitionBy()
    return days.select("day", "n", F.avg("n").over(over).alias("mean"), F.stddev_samp("n").over(over).alias("std"))


def top_per_bucket(logs: DataFrame, seconds: int, column: str, n: int = 3) -> DataFrame:
    """(bucket, column, n, rank): the most frequent values of each bucket, ties by value."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("n").desc(), column))
    return per_bucket(logs, seconds, column).withColumn("rank", rank).where(F.col("rank") <= n)


def top_as_map(logs: DataFrame, bucket: Column, column: str, n: int = 3) -> DataFrame:
    """(bucket, top): a map of the most frequent values of each bucket."""
    counts = logs.groupBy(bucket.alias("bucket"), column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("n").desc(), column))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= n)
    return kept.groupBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("top"))


def distinct_counts(logs: DataFrame, *columns: str) -> DataFrame:
    return logs.agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def cluster_sizes(rows: DataFrame, column: str = "cluster_id") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def cluster_members(rows: DataFrame, column: str = "cluster_id", key: str = "_id") -> DataFrame:
    return rows.groupBy(column).agg(F.array_sort(F.collect_list(key)).alias("members"))


def keyword_counts(texts: DataFrame, words: Column, n: int = 10) -> DataFrame:
    """(word, n) of the most frequent words of all texts."""
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(n)


def text_keywords(texts: DataFrame, key: str, most: int = 10, shortest: int = 2) -> DataFrame:
    """(key, keywords): each text's most frequent words, comma-joined, ties by first appearance. By
    counting rows: for long texts, where text.keywords would compare all of a text's words."""
    words = texts.select(key, F.posexplode(plain_words(F.col("message"), shortest)).alias("at", "word"))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "at"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("top"))
    joined = F.array_join(F.transform("top", lambda x: x["word"]), ",")
    return texts.select(key).join(top, key, "left").select(key, F.coalesce(joined, F.lit("")).alias("keywords"))


def prediction_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.sum("prediction").alias("anomalies"), F.avg("prediction").alias("ratio"))

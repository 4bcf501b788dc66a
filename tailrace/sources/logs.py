"""Scans of log tables, sinks with upsert, the high-water mark, vector tables."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailrace.functions.filters import compile_filter
from tailrace.schema import FieldMap


def connect(spark: SparkSession, path: str) -> DataFrame:
    """The table at path; fails at once if there is none."""
    return spark.read.parquet(path)


def logs_view(events: DataFrame) -> DataFrame:
    """The events table as log rows: _id, ts, log_level, service_name, template_key, message."""
    k = F.get_json_object("props", "$.k").cast("long")
    level = F.create_map(*(F.lit(x) for x in ("error", "ERROR", "signup", "WARN", "view", "INFO", "purchase", "INFO", "click", "DEBUG")))[F.col("event_type")]
    text = F.concat(
        F.lit("["), level, F.lit("] user="), F.col("user_id"), F.lit(" code=E"), k % 7, F.lit(" from 10.0."), F.col("user_id") % 256, F.lit("."), k, F.lit(" took "), k, F.lit("ms"),
        F.when(level == "ERROR", F.concat(F.lit(" System.TimeoutException: call "), F.col("event_id"), F.lit(" failed at handler"))).otherwise(""),
    )
    return events.select(
        F.col("event_id").cast("string").alias("_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        level.alias("log_level"),
        F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("service_name"),
        F.concat("event_type", F.lit("-E"), k % 7).alias("template_key"),
        text.alias("message"),
    )


def scan(logs: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None, query_filter: dict | list | None = None, fields: list[str] | None = None, max_logs: int | None = 100_000) -> DataFrame:
    """Rows within [start, end] that meet all filters, the wanted columns, oldest first, at most
    max_logs of them (exactly; None: all). Filters and columns reach the file scan."""
    if start is not None:
        logs = logs.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        logs = logs.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    for f in query_filter if isinstance(query_filter, list) else [query_filter] if query_filter else []:
        logs = logs.where(compile_filter(f))
    order = [c for c in ("ts", "_id") if c in logs.columns]
    kept = logs if fields is None else logs.select(*dict.fromkeys([*order, *fields]))
    kept = kept.orderBy(*order)
    kept = kept if max_logs is None else kept.limit(max_logs)
    return kept if fields is None else kept.select(*fields)


def with_file_metadata(logs: DataFrame) -> DataFrame:
    """Scanned rows with the file they come from as _index."""
    return logs.withColumn("_index", F.col("_metadata.file_path"))


def high_water_mark(logs: DataFrame) -> DataFrame:
    """One row: the latest ts, null for an empty table."""
    return logs.agg(F.max("ts").alias("last_ts"))


def latest_timestamp(spark: SparkSession, path: str) -> datetime | None:
    """The latest ts of a table that may not exist."""
    try:
        return high_water_mark(spark.read.parquet(path)).first()["last_ts"]
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def latest_per_id(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Of each id the row that comes last in order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc() if isinstance(order, str) else order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(existing: DataFrame | None, new: DataFrame, key: str = "_id") -> DataFrame:
    """existing with the rows of new in place of those with the same id; of new, one row for each id:
    the latest by ts where there is one, of several such rows the greatest by their columns."""
    kinds = dict(new.dtypes)
    plain = [c for c in new.columns if c != key and kinds[c] in ("timestamp", "string", "bigint", "int")]
    plain = sorted(plain, key=lambda c: c != "ts")
    rest = [c for c in new.columns if c not in plain and not kinds[c].startswith("map")]
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in plain), F.xxhash64(*rest))
    one = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return one if existing is None else existing.join(one.select(key), key, "left_anti").select(*existing.columns).unionByName(one, allowMissingColumns=True)


def files(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a folder, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save(rows: DataFrame, path: str, mapping: FieldMap | None = None, key: str = "_id") -> tuple[int, bool]:
    """Merges rows into the table at path by id, a table by day where they have a ts; (rows taken in,
    whether all went well). Days that hold none of the ids, old or new, are not touched. Rows without
    an id column are added. The days are written beside the table first and moved in one by one."""
    spark, out = rows.sparkSession, rows.drop("_index", "_score")
    by_day = ["day"] if "ts" in rows.columns else []
    if by_day:
        out = out.withColumn("day", F.to_date("ts"))
    if key in rows.columns:
        out = upsert(None, out, key)
    out = mapping.physical(out) if mapping else out
    fs, target = files(spark, path)
    staged = f"{path}.new"
    out.write.mode("overwrite").partitionBy(*by_day).parquet(staged)
    new = spark.read.schema(out.schema).parquet(staged)
    count = new.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not fs.exists(target) or key not in new.columns:
        new.write.mode("append").partitionBy(*by_day).parquet(path)
        fs.delete(files(spark, staged)[1], True)
        return count, True
    old = spark.read.parquet(path)
    # the days of the new rows, and those where their older versions stand
    met = old.join(new.select(key), key, "left_semi")
    days = met.select("day").unionByName(new.select("day")).distinct() if by_day else None
    touched = old.join(days.withColumnRenamed("day", "__day"), F.col("day").eqNullSafe(F.col("__day")), "left_semi") if by_day else old
    merged = f"{path}.merged"
    touched.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).write.mode("overwrite").partitionBy(*by_day).parquet(merged)
    moved = sorted("__HIVE_DEFAULT_PARTITION__" if r["day"] is None else str(r["day"]) for r in days.collect()) if by_day else []
    for part in [f"/day={d}" for d in moved] if by_day else [""]:
        fs.delete(files(spark, path + part)[1], True)
        source = files(spark, merged + part)[1]
        if fs.exists(source):
            fs.rename(source, files(spark, path + part)[1])
    for done in (staged, merged):
        fs.delete(files(spark, done)[1], True)
    spark.catalog.refreshByPath(path)
    return count, True


def save_json(rows: DataFrame, summary: dict, path: str) -> str:
    """Rows as JSON lines and a summary of one row beside them; "" if there are no rows."""
    if rows.isEmpty():
        return ""
    rows.write.mode("overwrite").json(f"{path}/data")
    rows.sparkSession.createDataFrame([(json.dumps(summary, default=str, sort_keys=True),)], "metadata string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return path


def save_watermark(spark: SparkSession, path: str, value: datetime) -> None:
    spark.createDataFrame([(value,)], "last_ts timestamp").coalesce(1).write.mode("overwrite").parquet(path)


def payload(rows: DataFrame, content: str = "message") -> DataFrame:
    """(id, vector, metadata) rows for a vector table: the text and the mapped fields, times as ISO text."""
    pairs = [F.lit("original_text"), F.col(content)]
    for name, column in (("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), ("log_level", F.col("log_level")), ("service_name", F.col("service_name"))):
        if {"timestamp": "ts"}.get(name, name) in rows.columns:
            pairs += [F.lit(name), column]
    return rows.select(F.col("_id").alias("id"), "vector", F.create_map(*pairs).alias("metadata"))


def add_vectors(existing: DataFrame | None, new: DataFrame, dim: int) -> DataFrame:
    """The vector table with new points; a vector of another length fails the job."""
    checked = new.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector does not have {dim} components"))))
    return upsert(existing, checked, "id")


def update_payload(points: DataFrame, updates: DataFrame) -> DataFrame:
    """points with the metadata of updates(id, metadata) laid over theirs."""
    u = updates.select("id", F.col("metadata").alias("__new"))
    return points.join(u, "id", "left").withColumn("metadata", F.when(F.col("__new").isNull(), F.col("metadata")).otherwise(F.map_concat("metadata", "__new"))).drop("__new")

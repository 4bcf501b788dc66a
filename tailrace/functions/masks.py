"""Masking variable parts of messages, template ids, duplicates inside time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.text import FLAGS
from tailrace.functions.times import floor_to

# Fixed values, in order.
MASKS = (
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<DATE>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<TIME>"),
    (r"(?<=[^A-Za-z0-9])(\d+)(?=[^A-Za-z0-9]|$)", "<NUM>"),
    (r'\b([a-zA-Z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*)', "<PATH>"),
    (r'\b((?:/[^/:*?"<>|\r\n]+)+/?)', "<PATH>"),
    (r"(['\"])(?:(?=(\\?))\2.)*?\1", "<STR>"),
)


def masked(text: Column) -> Column:
    for pattern, tag in MASKS:
        text = F.regexp_replace(text, FLAGS + pattern, tag)
    return text


def with_templates(logs: DataFrame) -> DataFrame:
    """logs with template, the masked message, and template_id, templates numbered by first appearance.
    Only the distinct templates are numbered in one place, never the rows."""
    logs = logs.withColumn("template", masked(F.col("message")))
    first = logs.groupBy("template").agg(F.min(F.struct("ts", "_id")).alias("first"))
    ids = first.select("template", F.row_number().over(Window.orderBy("first")).alias("template_id"))
    return logs.join(ids, "template")


def first_in_bucket(logs: DataFrame, minutes: int = 60) -> DataFrame:
    """The first row of each service, time bucket and masked message. Rows without service are a
    service of their own."""
    w = Window.partitionBy("service_name", floor_to(F.col("ts"), 60 * minutes), masked(F.col("message"))).orderBy("ts", "_id")
    return logs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

"""Duplicate logs by their vectors: neighbours, connected components, latest rows of each cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailrace.checkpoints import checkpointed
from tailrace.functions.vectors import neighbours


@dataclass
class DedupConfig:
    similarity_threshold: float = 0.92
    novelty_threshold: float = 0.05
    time_window_hours: int = 24
    min_cluster_size: int = 2
    keep_latest_count: int = 3
    keep_anomalies: bool = True

    def update(self, **changes: float) -> dict:
        for k, v in changes.items():
            if v is not None:
                setattr(self, k, type(getattr(self, k))(v))
        return vars(self).copy()


def reach(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): label is the smallest node reached. Labels spread along edges, then jump to their
    label's label; every round is checkpointed."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("label")))
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("m"))
        near = labels.join(around, "x").select("x", F.least("label", "m").alias("label"))
        jump = near.select(F.col("x").alias("label"), F.col("label").alias("further"))
        new = checkpointed(near.join(jump, "label", "left").select("x", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "x").where("label <> old").isEmpty()
        labels = new
        if changed:
            return labels.withColumnRenamed("x", "node")
    raise RuntimeError("clusters have not settled")


def dbscan(points: DataFrame, similarity: float = 0.92, min_samples: int = 2) -> DataFrame:
    """(id, dup_cluster_id): DBSCAN on cosine distance 1 - similarity; -1 is noise. points(id, vector), and
    copies where a row stands for several. Clusters are the
    connected components of core points; a border point joins the smallest core next to it. Labels
    count the clusters by their smallest member."""
    # equal vectors stand together, with their number: copies make no pairs. Zero vectors are near nothing, each alone
    zero = F.forall("vector", lambda x: x == 0)
    number = F.col("copies") if "copies" in points.columns else F.lit(1)
    named = points.select("id", "vector", number.alias("copies"), F.when(zero, F.col("id").cast("string")).otherwise("").alias("__alone"))
    groups = named.where("vector IS NOT NULL").groupBy("vector", "__alone").agg(F.min("id").alias("rep"), F.sum("copies").alias("copies"))
    copies = groups.select(F.col("rep").alias("id"), "copies")
    # pairs are found once, and read several times
    edges = checkpointed(neighbours(groups.select(F.col("rep").alias("id"), "vector"), similarity))
    around = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
    degree = around.join(copies.withColumnRenamed("id", "other"), "other").select("id", "copies").unionAll(copies).groupBy("id").agg(F.sum("copies").alias("n"))
    core = degree.where(F.col("n") >= min_samples).select("id")
    inner = edges.join(core.withColumnRenamed("id", "a"), "a").join(core.withColumnRenamed("id", "b"), "b")
    labels = reach(inner.select("a", "b"))
    labels = labels.unionByName(core.join(labels.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.col("id").alias("label")))
    rim = edges.select(F.col("a").alias("id"), F.col("b").alias("node")).unionAll(edges.select(F.col("b").alias("id"), F.col("a").alias("node")))
    rim = rim.join(core, "id", "left_anti").join(labels, "node").groupBy("id").agg(F.min_by("label", "node").alias("label"))
    members = labels.select(F.col("node").alias("id"), "label").unionByName(rim)
    ranked = members.select("label").distinct().withColumn("dup_cluster_id", F.row_number().over(Window.orderBy("label")) - 1)
    found = members.join(ranked, "label").select(F.col("id").alias("rep"), "dup_cluster_id").join(groups, "rep")
    found = named.drop("copies").join(found, ["vector", "__alone"]).select("id", "dup_cluster_id")
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("dup_cluster_id", F.lit(-1)).cast("int").alias("dup_cluster_id"))


def keep_latest(rows: DataFrame, keep: int = 3, keep_anomalies: bool = True, seed: int = 42) -> DataFrame:
    """Of rows with dup_cluster_id all noise, the latest `keep` of each cluster and all anomalies.
    Rows without ts are chosen by a seeded hash."""
    order = F.col("ts").desc_nulls_last() if "ts" in rows.columns else F.xxhash64("_id", F.lit(seed)).asc()
    rank = F.row_number().over(Window.partitionBy("dup_cluster_id").orderBy(order, "_id"))
    kept = (F.col("dup_cluster_id") == -1) | (F.col("__n") <= keep)
    if keep_anomalies and "prediction" in rows.columns:
        kept = kept | (F.col("prediction") == 1)
    # noise has no order to keep: it does not take part in the ranking
    noise, clustered = rows.where("dup_cluster_id = -1"), rows.where("dup_cluster_id <> -1").withColumn("__n", rank)
    return clustered.where(kept).drop("__n").unionByName(noise)


def deduplicate(logs: DataFrame, config: DedupConfig | None = None) -> DataFrame:
    """logs(_id, ts, vector, ...) without near copies, with dup_cluster_id."""
    c = config or DedupConfig()
    found = dbscan(logs.select(F.col("_id").alias("id"), "vector"), c.similarity_threshold, c.min_cluster_size)
    return keep_latest(logs.join(found.withColumnRenamed("id", "_id"), "_id"), c.keep_latest_count, c.keep_anomalies)


def statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: total_processed, duplicates_removed, dedup_rate (0 if nothing was processed)."""
    both = before.agg(F.count("*").alias("total_processed")).join(after.agg(F.count("*").alias("kept")), F.lit(True))
    gone = F.col("total_processed") - F.col("kept")
    return both.select("total_processed", gone.alias("duplicates_removed"), F.when(F.col("total_processed") == 0, 0.0).otherwise(gone / F.col("total_processed")).alias("dedup_rate"))

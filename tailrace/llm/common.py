"""What the corpus operators share: tables, words, Arrow batches, checkpoints, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than ASCII white space; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python stage turns into arrays at once; a longer text goes alone.
BLOCK_BYTES = 4_000_000
#: Spark's bound of an Arrow batch on its way to a Python worker. At its default of 64 MB a task holds
#: such a batch in the JVM's buffers and in the worker, though the stages work on blocks.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; where that is
    unset (tests, one machine), one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new folder in the shared one, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about BLOCK_BYTES, or one row. Rows and results stay
    as they are; plans are made when a frame is written, so the setting stays too."""
    spark.conf.set(BATCH_BYTES, str(BLOCK_BYTES))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's values of a block have `most` bytes, or are one value."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) for each node of the edges (a, b): label is the smallest node that it reaches.

    Alternating large-star and small-star steps; each is an aggregation by node with map-side combining,
    written down, and a join with it alone: a node with very many neighbours is a skewed key of a plain
    join, which adaptive execution splits among tasks. Every round is checkpointed. The result is complete whatever the number of rounds up to the limit;
    beyond it an error is raised. No edges: no rows.
    """
    stars = checkpointed(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = stars.select("a", "b").unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # large star: each greater neighbour is tied to the smallest node around
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.where("a <> b").distinct())
        # small star: the smaller neighbours, and the node itself, are tied to the smallest of them
        low = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        stars = checkpointed(small.where("a <> b").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = stars.select(F.col("b").alias("node")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots.select("node", F.col("node").alias("label")))
        before = now
    raise RuntimeError(f"the components have not settled after {rounds} rounds")

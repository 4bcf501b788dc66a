"""Corpus preparation from documents to tokens: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tailrace.llm import bpe, linededup, mixing, quality, registry, simhash
from tailrace.llm.common import small_batches, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject. The model is learned from the labels
    of the corpus at sf_dir; null and empty texts are scored like any other."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that an earlier one has; rows without doc_id come last.
    Rows of which nothing is left go; null texts become empty ones."""
    return linededup.without_repeats(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash near-duplicates: the smallest doc_id, there the smallest
    text. Rows without doc_id cannot be told apart and stay."""
    small_batches(spark)
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them; without words, once. A null source
    is a source; rows without doc_id count each for itself."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document in the mix; an empty text has no tokens."""
    small_batches(spark)
    return bpe.round_trip(docs, registry.tokenizer_path())


STAGES = [("quality", good_quality), ("line_dedup", unique_lines), ("simhash", one_of_near_copies), ("mix", mixed_sources), ("bpe", tokens)]

#: Compression, fingerprints and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage keeps is written as Parquet to the folder that the
    cluster shares and read again for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

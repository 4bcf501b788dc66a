"""What the pipeline's stages leave in the executors' Python processes."""

import gc
import json
import weakref
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark import SparkContext
from tailrace.llm import bpe, quality, registry


def test_fit_starts_no_python_rdd(spark, docs, monkeypatch):
    """A Python RDD has a daemon and workers beside those of the stages."""
    rows = [(i, f"{'bad' if i % 2 else 'good'} text number {i} " * 20) for i in range(24)]
    frame = docs(rows)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")

    def never(*a, **b):
        raise AssertionError("a Python RDD")

    monkeypatch.setattr(SparkContext, "parallelize", never)
    model = quality.fit(frame, labels)
    assert model.dictionaries is not None and 0 < model.share < 1


def test_a_dropped_tokenizer_is_freed():
    made = bpe.Tokenizer(json.loads(Path(registry.tokenizer_path()).read_text(encoding="utf-8")))
    assert made.decode(made.encode("a few words")) != ""
    left = weakref.ref(made.automaton)
    del made
    gc.collect()
    assert left() is None


@pytest.mark.parametrize("stage", ["simhash", "bpe"])
def test_stages_send_small_batches(spark, docs, stage):
    """Twelve texts of a MB come in several batches, each of them whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs([(1, "a b c d e")]), "")

        def measured(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

        got = spark.range(0, 12, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text").mapInArrow(measured, "size long, n long").collect()
        assert sum(r.n for r in got) == 12 and sum(r["size"] for r in got) > 12_000_000
        assert max(r["size"] for r in got) < 6_000_000
    finally:
        spark.conf.set(key, before)

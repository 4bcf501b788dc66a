"""The context block takes whole messages; only the limit of tokens cuts it."""

from datetime import datetime

import pytest

from tailrace.operators import prompting
from tailrace.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("words,cut", [(700, False), (900, True)])
def test_limit_of_tokens(spark, words, cut):
    text = " ".join(f"word{i}" for i in range(words))
    hits = spark.createDataFrame([(i, i, datetime(2024, 1, 1), "ERROR", "s", text, 0.0) for i in range(6)], "id long, rank long, timestamp timestamp, log_level string, service_name string, message string, final_score double")
    got = prompting.context_block(hits).first()
    assert (got.token_estimate > 4000) == cut and got.context.endswith(prompting.CUT) == cut
    assert len(got.context) == 2400 + len(prompting.CUT) if cut else got.context.count(text) == 5


def test_registered_over_whole_messages(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(5).withColumnRenamed("vec_id", "doc_id")
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(e, "doc_id").orderBy("doc_id").collect()]
    assert any(len(t) > 200 for t in texts)
    got = catalog.queries()["context_block"](spark, SF).first()
    print("tokens", got.token_estimate, [len(t) for t in texts])
    assert got.context.endswith(prompting.CUT) if got.token_estimate > 4000 else all(t in got.context for t in texts)

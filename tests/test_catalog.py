"""Every registered query runs on the smallest tables; where there is SQL, the results are equal."""

import math
import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from tailrace.plans import catalog
from tailrace.service import LogService

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    value = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name])
        assert sorted(want.columns) == columns
        assert plain(rows) == plain(want.select(*columns).fetchall())


@pytest.mark.parametrize("left", ["nothing", "pipeline", "caches"])
def test_without_the_corpus_part(tmp_path, left):
    """The entry point imports and registers the rest when the corpus operators are gone, whatever is left of them."""
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "tailrace").mkdir()
    for p in root.glob("tailrace/*"):
        if p.name != "llm":
            (tmp_path / "tailrace" / p.name).symlink_to(p)
    # copies: a link's target would put the whole repository on the path
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if left != "nothing" and (root / "corpus_pipeline.py").exists() else [])]:
        (tmp_path / name).write_text((root / name).read_text())
    if left == "caches":
        (tmp_path / "tailrace" / "llm" / "__pycache__").mkdir(parents=True)
        (tmp_path / "tailrace" / "llm" / "__pycache__" / "registry.cpython-313.pyc").write_bytes(b"")
    code = f"import sys; sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ('', {str(root)!r})]; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]


def test_service(spark):
    s = LogService(spark, catalog.logs(spark, SF))
    day = ("2024-01-01", "2024-01-20")
    assert s.stats().first().total_logs == s.logs.count() and s.services().count() == 8
    s.vectorize_logs(*day, max_logs=200)
    found = s.search("timeoutexception failed handler", log_levels=["ERROR"], now=datetime(2024, 2, 1), max_results=7)
    rows = found["results"].collect()
    assert found["status"] == "success" and found["total"] >= len(rows) == 7 and {r.log_level for r in rows} == {"ERROR"}
    assert s.search(" ")["status"] == "error"
    made = s.generate_prompt("why failed timeoutexception", now=datetime(2024, 2, 1), include_vectors=False)
    assert made["query_intent"]["query_type"] == "cause_analysis" and "[日志 1]" in made["prompt"]
    assert s.analyze_anomalies(*day, services=["svc-1"])["status"] in ("success", "no_errors")
    assert s.analyze_patterns(*day)["status"] == "success"
    assert s.update_search_weights(weights_config='{"es_weight": 0.2, "vector_weight": 0.5}')["new_weights"]["es_weight"] == 0.2
    assert s.process_and_vectorize(now=datetime(2023, 1, 1))["status"] == "no_new_data"

"""Vectors: cosine as a Column, embedders, exact top-k, novelty, near neighbours in blocks."""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 128
#: Rows of one block of the neighbour search.
BLOCK_ROWS = 4096


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def hashed(text: str, dimension: int = DIMENSION) -> list[float]:
    """A deterministic embedding without a model: signed counts of hashed words and letter triples."""
    v = np.zeros(dimension)
    for word in re.findall(r"\w+", text.lower()) or [" "]:
        for part in (word, *(f"#{word}#"[i : i + 3] for i in range(len(word)))):
            h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
            v[h % dimension] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def embedder(embed: Callable[[list[str]], list[list[float]]] | None = None, dimension: int = DIMENSION) -> Callable[[Column], Column]:
    """A column function from a model: any function of a list of texts. Blank texts become " "; where
    the model fails the batch gets zero vectors, which the worker's log reports with their number.
    Default: the hashing embedder."""

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        texts = [t if t and t.strip() else " " for t in text]
        try:
            return pd.Series(embed(texts) if embed else [hashed(t, dimension) for t in texts])
        except Exception as failed:  # noqa: BLE001  a model may fail in any way
            logging.getLogger(__name__).warning("the model failed, %d texts get zero vectors: %s", len(texts), failed)
            return pd.Series([[0.0] * dimension for _ in texts])

    return run


def top_k(points: DataFrame, query: list[float], k: int, least: float | None = None, where: Column | None = None) -> DataFrame:
    """points(id, vector, ...) with score, the k most similar to the query; filters come before the
    choice, so none is lost to them."""
    points = points if where is None else points.where(where)
    scored = points.withColumn("score", cosine(F.col("vector"), literal(query)))
    return (scored if least is None else scored.where(F.col("score") >= least)).orderBy(F.col("score").desc(), "id").limit(k)


def novelty(points: DataFrame, history: DataFrame, least: float = 0.05, most_history: int = 10_000) -> DataFrame:
    """points(id, vector) with the smallest cosine distance to the history and whether it is above
    `least`. The history is a ring of at most `most_history` vectors, the newest by ts, else by id, and
    goes to every task."""
    newest = [F.col(c).desc() for c in ("ts", "id", "_id") if c in history.columns]
    rows = [r["vector"] for r in (history.orderBy(*newest) if newest else history).select("vector").limit(most_history).collect()]
    known = np.array(rows, dtype=np.float64).reshape(len(rows), -1)
    known = known / np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12) if len(rows) else known

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.Series(1 - (x @ known.T).max(axis=1) if len(known) else np.full(len(x), 2.0))

    return points.withColumn("distance", distance("vector")).withColumn("novel", F.col("distance") > least)


def neighbours(points: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) pairs of ids, a < b, whose vectors have a cosine similarity of at least `least`.

    Every block of rows meets every other one once, as matrices; only pairs above the threshold leave
    a task. Exact; the work is that of all pairs, so it is meant for rows left by cheaper steps.
    """
    n = points.count()
    blocks = max(1, -(-n // block_rows))
    of = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = points.select("id", doubles(F.col("vector")).alias("vector"), of.alias("block"))
    here = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y")))
    dealt = rows.withColumn("cell", F.explode(here)).select("cell.x", "cell.y", "block", "id", "vector")

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        ids, block = np.array(table.column("id").to_pylist(), dtype=object), table.column("block").to_numpy()
        v = np.array(table.column("vector").to_pylist(), dtype=np.float64).reshape(len(ids), -1)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        x, y = (np.flatnonzero(block == k.as_py()) for k in key)
        i, j = np.nonzero(v[x] @ v[y].T >= least)
        a, b = ids[x[i]], ids[y[j]]
        keep = a < b if key[0] == key[1] else a != b
        a, b = a[keep], b[keep]
        return pa.table({"a": np.where(a < b, a, b).tolist(), "b": np.where(a < b, b, a).tolist()}, schema=pa.schema([("a", table.schema.field("id").type), ("b", table.schema.field("id").type)]))

    kind = dict(points.dtypes)["id"]
    return dealt.groupBy("x", "y").applyInArrow(pairs, f"a {kind}, b {kind}")


def batches(rows: Iterator, n: int) -> Iterator[list]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held

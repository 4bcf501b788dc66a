"""A quality classifier from compression: zstandard dictionaries of good and of bad text.

A text that resembles what a dictionary was built from compresses to fewer bytes with it. A text is
compressed in pieces, each on its own, so that what it repeats does not hide what it is like. The
difference of its sizes with the two dictionaries, a byte, goes through a logistic calibration that
was fitted to other labelled rows than the dictionaries. Beside the difference the calibration knows
one more number: how small the text gets without a dictionary, since text that says one thing over
and over gets as small with either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.llm.common import blocks

#: Bound of the sample: labelled documents of each class for its dictionary, and for the calibration.
DICTIONARY_DOCS, CALIBRATION_DOCS = 1500, 3000
#: Characters of a piece; sampled documents go to the dictionary trainer whole, in such pieces.
PIECE_CHARS = 8000
DICTIONARY_BYTES, LEVEL = 65536, 1
#: Bytes that are compressed at once.
PIECE_BYTES = 1024
GOOD_FROM = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def compressors(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in dictionaries] + [zstandard.ZstdCompressor(**plain)]


def features(sizes: np.ndarray) -> np.ndarray:
    """(difference, own size) a byte, from (bytes, bytes with the bad, the good and no dictionary)."""
    n = np.maximum(sizes[:, 0].astype(float), 1.0)
    return np.stack([(sizes[:, 1] - sizes[:, 2]) / n, sizes[:, 3] / n], axis=1)


@dataclass(frozen=True)
class Model:
    """dictionaries (bad, good); mean, scale and weights of the calibration, bias first. Without
    dictionaries (a class has no labelled text) every text gets the share of good labels."""

    dictionaries: tuple[bytes, bytes] | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(sizes), self.share)
        z = (features(sizes) - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sizes_of(dictionaries: tuple[bytes, bytes] | None) -> Callable:
    """A mapInArrow function from (doc_id, text) to (doc_id, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressors(dictionaries) if dictionaries else []
        for b in blocks(batches, "text"):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            rows = [[len(t), *(sum([len(c.compress(t[i : i + PIECE_BYTES])) for i in range(0, len(t), PIECE_BYTES)]) for c in by)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "sizes"])

    return run


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; from too few samples for that, their own bytes."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\n" * 16


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method, features scaled, the bias not penalised."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, penalty = np.zeros(z.shape[1]), np.r_[1e-6, np.full(z.shape[1] - 1, ridge)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out: the first of
    each class in the order of their ids' MD5. Labels other than 0 and 1, and ids or labels that are
    null, are passed over; an id labelled twice counts by its smaller label, an id with several texts
    by the smallest of them. Null and empty texts say nothing for a dictionary. Without both classes,
    or without rows, the model knows the share of good labels alone (a half without labels)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("quality").alias("quality")).withColumn("key", F.md5(F.col("id").cast("string").cast("binary")))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    # bounded by the two parameters: ids and labels only
    sample = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy("key").limit(DICTIONARY_DOCS + CALIBRATION_DOCS).collect()]
    if len(counts) < 2:
        return Model(None, np.zeros(0), np.ones(0), np.zeros(0), share)
    use: dict[int, list[tuple[int, int]]] = {0: [], 1: []}  # for dictionaries, for the calibration
    of_class = {q: [r["id"] for r in sample if r["quality"] == q] for q in (0, 1)}
    for q, ids in of_class.items():
        n = min(DICTIONARY_DOCS, (len(ids) + 1) // 2)
        use[0] += [(i, q) for i in ids[:n]]
        use[1] += [(i, q) for i in ids[n:] or ids]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def chosen(rows: list[tuple[int, int]]) -> DataFrame:
        # an Arrow table becomes a local relation; a list would start a second daemon with workers of its own on each executor
        small = docs.sparkSession.createDataFrame(pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "quality": pa.array([q for _, q in rows], pa.int32())}))
        return texts.join(F.broadcast(small), texts.doc_id == small.id).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    # no more rows than ids were chosen, whole
    seen = chosen(use[0]).orderBy("doc_id").collect()
    by_class = tuple([t[i : i + PIECE_CHARS].encode() for r in seen if r["quality"] == q and (t := r["text"]) for i in range(0, len(t), PIECE_CHARS)] for q in (0, 1))
    if not all(by_class):
        return Model(None, np.zeros(0), np.ones(0), np.zeros(0), share)
    dictionaries = (dictionary(by_class[0]), dictionary(by_class[1]))
    quality = dict(use[1])
    rows = chosen(use[1]).select("doc_id", "text").mapInArrow(sizes_of(dictionaries), "doc_id long, sizes array<long>").orderBy("doc_id").collect()
    if len({quality[r["doc_id"]] for r in rows}) < 2:
        return Model(None, np.zeros(0), np.ones(0), np.zeros(0), share)
    y = np.array([quality[r["doc_id"]] for r in rows])
    # the sample is taken by class: weights bring the classes' shares back
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    return Model(dictionaries, *calibrate(features(np.array([r["sizes"] for r in rows])), y, weight), share)


def score(docs: DataFrame, model: Model, good_from: float = GOOD_FROM) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs. score is between 0 and 1,
    higher where a good label is likelier; empty and null texts count as texts of no bytes. Only the
    text is read for a score. Other columns are ignored."""
    sizes = sizes_of(model.dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sizes(batches):
            found = np.array(b.column("sizes").to_pylist(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(found))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= good_from).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, good_from: float = GOOD_FROM) -> DataFrame:
    """The rows of docs that the model does not reject, all their columns, repeats included. Null and
    empty texts are scored as texts of no bytes. Empty table: no rows."""
    sizes, names, kinds = sizes_of(model.dictionaries), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            found = np.concatenate([np.array(x.column("sizes").to_pylist(), dtype=np.int64) for x in sizes(iter([b.select(["doc_id", "text"])]))])
            kept = b.filter(pa.array(model.scores(found) >= good_from))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, kinds).select(*names)

"""Exact top-k search by a Voronoi join.

Queries are grouped by their nearest pivot, pivots being means of a bounded sample of queries. For a
group with pivot a and radius r, and a row x, every query's product with x lies within r |x| of a.x.
A first pass over the data gives each group a score that its k-th best is sure to reach: the k-th
largest of the lower bounds a.x - r |x|. A second pass hands each row to exactly the groups whose sure
score its upper bound a.x + r |x| reaches. Groups meet their rows in blocks of bounded size, which are
solved by matrix products; the blocks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailrace.llm.common import checkpointed, partitions

#: Groups of queries: at least, and rows of each, about; sampled queries for each pivot, and rounds of means.
GROUPS, QUERY_ROWS, SAMPLE_ROWS, ROUNDS = 4, 4096, 64, 8
#: Groups at most: their pivots are sent to every task. Larger groups are dealt out in chunks of QUERY_ROWS.
MOST_GROUPS = 256
#: Rows of data in a block, about.
BLOCK_ROWS = 8192
SCALE = 256


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component. Rows take no part whose id or
    vector is null, or that hold a null or non-finite component."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite).select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    column = column if isinstance(column, pa.ListArray) else column.combine_chunks()
    flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)] = flat
    return out


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest pivot, distance to it) of each row; the distance is worked out again
    from the difference, so that its rounding stays relative to itself."""
    x = x.astype(np.float64)
    g = np.argmin((pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T, axis=1)
    return g, np.sqrt(((x - pivots[g]) ** 2).sum(axis=1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where these hold every sum, else in whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Best:
    """The k best of each query so far: score descending, then id ascending. rows name the queries,
    ids what they are called; a query never meets its own row."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.own, self.ids, self.q, self.k = rows, ids, q, k
        self.score, self.of = (np.zeros((len(ids), 0), dtype=np.int64) for _ in range(2))

    def see(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(self.ids), 1024):
            part = slice(at, at + 1024)
            s = products(self.q[part], x)
            low = np.iinfo(np.int64).min
            s[self.own[part][:, None] == rows[None, :]] = low
            score = np.concatenate([self.score[part], s], axis=1)
            of = np.concatenate([self.of[part], np.broadcast_to(ids, s.shape)], axis=1)
            if score.shape[1] > 4 * self.k:  # all that reach the k-th best, ties included, then in order
                kth = np.partition(score, -self.k, axis=1)[:, -self.k]
                most = int((score >= kth[:, None]).sum(axis=1).max())
                pick = np.argpartition(score, -most, axis=1)[:, -most:] if most < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                score, of = np.take_along_axis(score, pick, axis=1), np.take_along_axis(of, pick, axis=1)
            order = np.lexsort((of, -np.maximum(score, low + 1)), axis=1)[:, : self.k]
            score, of = np.take_along_axis(score, order, axis=1), np.take_along_axis(of, order, axis=1)
            if at == 0:
                new_score, new_of = [], []
            new_score.append(score)
            new_of.append(of)
        self.score, self.of = np.concatenate(new_score), np.concatenate(new_of)

    def found(self) -> pa.RecordBatch:
        real = self.score > np.iinfo(np.int64).min
        rows, ids = (np.broadcast_to(x[:, None], self.score.shape) for x in (self.own, self.ids))
        return pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (rows, ids, self.of, self.score)], names=["row", "query_id", "vec_id", "score"])


def means(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n pivots: means of the sample's rows about them, begun at rows far from one another."""
    pivots = sample[:1]
    far = ((sample - pivots[0]) ** 2).sum(axis=1)
    while len(pivots) < n and far.max(initial=0.0) > 0:
        pivots = np.concatenate([pivots, sample[[int(far.argmax())]]])
        far = np.minimum(far, ((sample - pivots[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        of = nearest(sample, pivots)[0]
        pivots = np.stack([sample[of == i].mean(axis=0) if (of == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def bounds(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and group the lower and the upper bound of its products with the group's queries,
    a little wider than they are, for rounding."""
    x = x.astype(np.float64)
    middle, size = x @ pivots.T, np.sqrt((x**2).sum(axis=1))[:, None]
    reach = radius[None, :] * size
    reach += 1e-9 * (1 + reach + np.sqrt((pivots**2).sum(axis=1))[None, :] * size)
    return middle - reach, middle + reach


def numbered(vectors: DataFrame, scale: int, every: int) -> tuple[DataFrame, dict | None]:
    """(row, vec_id, v) of the usable rows, row different for each, and their numbers; None without rows
    or queries. Where no id repeats, the id is the row; else the rows are written down with numbers."""
    v = usable(vectors, scale)
    query = F.col("vec_id") % every == 0
    size = v.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.max(F.size("v")).alias("dim"), F.count_if(query).alias("queries")).first().asDict()
    if size["ids"] < size["n"]:
        v = checkpointed(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    else:
        v = v.select(F.col("vec_id").alias("row"), "vec_id", "v")
    return v, size if size["queries"] else None


def voronoi(v: DataFrame, size: dict, k: int, every: int) -> DataFrame:
    """(g, c, b, kind, row, vec_id, v): every query (kind 0) once for each block of its group, every row
    that may be among the k best of a group's queries (kind 1) once for each chunk of that group."""
    dim = max(1, size["dim"])
    groups = min(MOST_GROUPS, max(GROUPS, -(-size["queries"] // QUERY_ROWS)))
    chosen = v.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(groups * SAMPLE_ROWS).collect()  # bounded by the two parameters
    sample = np.zeros((len(chosen), dim))
    for i, r in enumerate(chosen):
        sample[i, : len(r["v"])] = r["v"]
    pivots = means(sample, groups)
    groups = len(pivots)

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g, d = nearest(matrix(b.column("v"), dim), pivots)
                cells = np.unique(g)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([int((g == c).sum()) for c in cells], pa.int64()), pa.array([float(d[g == c].max()) for c in cells])], names=["g", "n", "radius"])

    asked = v.where(F.col("vec_id") % every == 0).select("v").mapInArrow(radii, "g int, n long, radius double").groupBy("g").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    n, radius = np.zeros(groups, dtype=np.int64), np.zeros(groups)
    for r in asked:
        n[r["g"]], radius[r["g"]] = r["n"], r["radius"] * (1 + 1e-9)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((0, groups), -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                low, _ = bounds(matrix(b.column("v").slice(at, 2048), dim), pivots, radius)
                best = np.concatenate([best, low])
                best = np.partition(best, -k - 1, axis=0)[-k - 1 :] if len(best) > k + 1 else best
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups), pa.int32()), pa.array(best.T.tolist(), pa.list_(pa.float64()))], names=["g", "low"])

    # one more than k: the query itself may be among them
    sure = np.full(groups, -np.inf)
    top = v.select("v").mapInArrow(lower, "g int, low array<double>").select("g", F.explode("low").alias("low"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("low").desc()))
    for r in top.withColumn("n", rank).where(F.col("n") == k + 1).select("g", "low").collect():
        sure[r["g"]] = r["low"]

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                total += (bounds(matrix(b.column("v").slice(at, 2048), dim), pivots, radius)[1] >= sure).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups), pa.int32()), pa.array(total)], names=["g", "n"])

    rows = np.zeros(groups, dtype=np.int64)
    for r in v.select("v").mapInArrow(reached, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        rows[r["g"]] = r["n"]
    n_blocks, chunks = np.maximum(1, -(-rows // BLOCK_ROWS)), np.maximum(1, -(-n // QUERY_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                ids, x = b.column("row").to_numpy(), matrix(b.column("v"), dim)
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                q = np.flatnonzero(b.column("vec_id").to_numpy() % every == 0)
                of, may = nearest(x[q], pivots)[0], bounds(x, pivots, radius)[1] >= sure
                rows, group, chunk, block, kind = [], [], [], [], []

                def add(i: np.ndarray, c: int, h: np.ndarray | int, s: np.ndarray | int, what: int) -> None:
                    rows.append(i)
                    for to, value in ((group, c), (chunk, h), (block, s), (kind, what)):
                        to.append(np.broadcast_to(value, i.shape))

                for c in np.flatnonzero(n):
                    i = np.flatnonzero(may[:, c])
                    for h in range(chunks[c]):
                        add(i, c, h, mixed[i].astype(np.int64) % n_blocks[c], 1)
                    i = q[of == c]
                    for s in range(n_blocks[c]):
                        add(i, c, (mixed[i] >> np.uint64(8)).astype(np.int64) % chunks[c], s, 0)
                i = np.concatenate(rows)
                taken = b.take(pa.array(i))
                columns = [pa.array(np.concatenate(z).astype(np.int32)) for z in (group, chunk, block, kind)]
                yield pa.RecordBatch.from_arrays([*columns, *(taken.column(name) for name in ("row", "vec_id", "v"))], names=["g", "c", "b", "kind", "row", "vec_id", "v"])

    return v.mapInArrow(deal, "g int, c int, b int, kind int, row long, vec_id long, v array<long>")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` the k highest
    integer inner products with all other rows, ties to the smaller vec_id; all, if there are fewer.

    Vectors are scaled and floored first. Rows without id, null vectors and those with null or
    non-finite components take no part; shorter vectors count as filled up with zeros. Rows that share
    an id are rows of their own: each is a candidate, of the others with its id as well, and each with
    a query's id is a query with a result of its own. Without usable rows or queries there is no result.
    """
    v, size = numbered(vectors, scale, every)
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, size["dim"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, best = None, [], None
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                keys = np.stack([b.column(n).to_numpy() for n in ("g", "c", "b", "kind")], axis=1)
                edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if hi == lo:
                        continue
                    this, part = tuple(keys[lo, :3]), b.slice(lo, hi - lo)
                    if this != key:
                        if best is not None:
                            yield best.found()
                        key, asked, best = this, [], None
                    x = part.column("row").to_numpy(), part.column("vec_id").to_numpy(), matrix(part.column("v"), dim)
                    if keys[lo, 3] == 0:
                        asked.append(x)
                    elif asked:
                        best = best or Best(*map(np.concatenate, zip(*asked, strict=True)), k)
                        best.see(*x)
        if best is not None:
            yield best.found()

    dealt = voronoi(v, size, k, every).repartition(partitions(vectors), "g", "c", "b").sortWithinPartitions("g", "c", "b", "kind")
    found = dealt.mapInArrow(solve, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

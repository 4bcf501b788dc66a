"""Pairs of similar texts by the ratio of matching blocks, exact, without comparing every pair."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a block; a cell compares two blocks. Characters are counted in so many bins.
BLOCK_TEXTS, BINS = 500, 256


def counts_of(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BINS), dtype=np.int32)
    for row, t in zip(out, texts, strict=True):
        row += np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % BINS, minlength=BINS).astype(np.int32)
    return out


def similar_texts(texts: DataFrame, threshold: float = 0.8, block_texts: int = BLOCK_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of texts(id, text). pairs: (i, j, similarity), i < j, for different texts whose
    difflib ratio is at least the threshold, each text under the smallest id that has it. members:
    (id, i), the id that stands for each text; copies are not expanded into pairs. Null counts as empty.

    The ratio is twice the matched characters by all characters, so lengths of a pair differ by at most
    (2 - threshold) / threshold: texts are filed by the logarithm of their length and meet their own
    file and the next. There blocks meet blocks; common counts of characters bound the ratio from
    above, and only what passes is compared. Memory is that of two blocks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    plain = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    groups = plain.groupBy("text").agg(F.min("id").alias("i"))
    members = plain.join(groups, "text").select("id", "i")
    kind = dict(texts.dtypes)["id"]
    out = f"i {kind}, j {kind}, similarity double"
    if threshold == 1:
        return texts.sparkSession.createDataFrame([], out), members
    # a little wider than the bound, so that rounding separates no pair
    width = math.log((2 - threshold) / threshold) * (1 + 1e-6)
    blocks = max(1, -(-groups.count() // block_texts))
    filed = groups.where("text <> ''").select(
        "i", "text", F.floor(F.log(F.length("text")) / F.lit(width)).cast("int").alias("file"), F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("block")
    )
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    cell = lambda low, step, x, y: F.struct(low.alias("file"), F.lit(step).alias("step"), x.alias("x"), y.alias("y"))
    file, block = F.col("file"), F.col("block")
    own = F.transform(others, lambda o: cell(file, 0, F.least(block, o), F.greatest(block, o)))
    next_file = F.transform(others, lambda o: cell(file, 1, block, o))
    previous = F.transform(others, lambda o: cell(file - 1, 1, o, block))
    dealt = filed.select("i", "text", F.col("file").alias("own"), "block", F.explode(F.concat(own, next_file, previous)).alias("cell"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        low, step, x, y = (k.as_py() for k in key)
        ids, words = table.column("i").to_pylist(), table.column("text").to_pylist()
        files, block = table.column("own").to_numpy(), table.column("block").to_numpy()
        left, right = np.flatnonzero((files == low) & (block == x)), np.flatnonzero((files == low + step) & (block == y))
        counts, sizes, found = counts_of(words), np.array([len(w) for w in words]), []
        for a in left:
            common = np.minimum(counts[a], counts[right]).sum(axis=1)
            for b in right[2 * common >= threshold * (sizes[a] + sizes[right]) - 1e-9]:
                if ids[a] == ids[b] or (step == 0 and x == y and ids[a] > ids[b]):
                    continue
                p, q = (a, b) if ids[a] < ids[b] else (b, a)
                ratio = difflib.SequenceMatcher(None, words[p], words[q]).ratio()
                if ratio >= threshold:
                    found.append((ids[p], ids[q], ratio))
        i, j, r = zip(*found, strict=True) if found else ((), (), ())
        of = table.schema.field("i").type
        return pa.table({"i": pa.array(i, of), "j": pa.array(j, of), "similarity": pa.array(r, pa.float64())})

    pairs = dealt.select("cell.*", "own", "block", "i", "text").groupBy("file", "step", "x", "y").applyInArrow(compare, out)
    return pairs, members

"""SimHash near-duplicates with pivot distance tables.

A fingerprint takes one bit from the majority of its shingles' hashes. Fingerprints within RADIUS
differing bits are linked; classes are the connected components of these links.

Search: 64 bits are cut into BLOCKS blocks; two fingerprints at most RADIUS bits apart agree in at
least BLOCKS - RADIUS of them, so each fingerprint is filed under every choice of that many blocks
(exact, no cap). A file with too many members is filed again in the same way by the bits that its
members need not share, so it is dealt to several tasks. Inside a file the pivot table decides: each
fingerprint's Hamming distances to fixed reference fingerprints are computed once, a pair whose
largest coordinate difference exceeds RADIUS is discarded (triangle inequality), the survivors are
verified by XOR and bit count. A large file yields a spanning forest of its links, never all of its
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailrace.llm.common import blocks, checkpointed, components, partitions

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 6
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: A file with more members is filed again.
FILE = 4096
#: A file up to this size is compared offset by offset, a larger one by search from member to member.
SMALL_FILE = 32


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint: A-Z lower-cased, words joined by one space, repeats counted.
    Fewer words than a shingle: the whole sequence is one shingle. No words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        bits += np.unpackbits(hashes[i : i + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint as a signed long. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: the hashes of their own numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], dtype=np.uint64)


def blocks_of(bits: list[int], parts: int) -> list[int]:
    """Masks that cut the bits, given by their places, into parts."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(parts: int = BLOCKS, radius: int = RADIUS, within: int = (1 << 64) - 1) -> list[int]:
    """One mask for each choice of parts - radius of the blocks of the bits in `within`."""
    return [sum(c) for c in combinations(blocks_of([i for i in range(64) if within >> i & 1], parts), parts - radius)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (i, j) are linked: pivot coordinates discard, XOR verifies."""
    left = np.arange(len(i))
    for p in range(table.shape[1]):
        d = table[i[left], p] - table[j[left], p]
        left = left[np.abs(d) <= radius]
    ok = np.zeros(len(i), dtype=bool)
    ok[left] = np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= radius
    return ok


def forest(fp: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one file: from each member reached, the members not yet
    reached are searched, so a tight group is spanned by a few passes."""
    out, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            ok = near(fp, table, np.full(len(rest), x), rest, radius)
            if ok.any():
                found, rest = rest[ok], rest[~ok]
                out.append((fp[np.full(len(found), x)], fp[found]))
                queue.extend(found.tolist())
    return out


def linked(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS, n_pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the files of rows sorted by file; group numbers the files."""
    table = np.bitwise_count(fp[:, None] ^ pivots(n_pivots)[None, :]).astype(np.int8)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(fp)])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    n = np.repeat(size, size)
    small = (n > 1) & (n <= SMALL_FILE)
    left = np.repeat(start + size, size) - np.arange(len(fp)) - 1  # members of the file behind this one
    for gap in range(1, min(SMALL_FILE, int(size.max(initial=0)))):
        i = np.flatnonzero(small & (left >= gap))
        if not len(i):
            break
        ok = near(fp, table, i, i + gap, radius)
        out.append((fp[i[ok]], fp[i[ok] + gap]))
    for s, k in zip(start[size > SMALL_FILE], size[size > SMALL_FILE], strict=True):
        out += forest(fp[s : s + k], table[s : s + k], radius)
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *(a for a, _ in out)]), np.concatenate([empty, *(b for _, b in out)])


def filed(fps: DataFrame, radius: int = RADIUS, parts: int = BLOCKS, most: int | None = None) -> DataFrame:
    """(t, key, sub, rest, fp): each fingerprint in all its files, of files with more than `most` members
    in all of their files within them."""
    first = masks(parts, radius)
    second = [signed(m) for w in first for m in masks(parts, radius, (1 << 64) - 1 ^ w)]
    n = len(second) // len(first)
    files = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(first)))
    once = fps.select("fp", F.explode(files).alias("f")).select("f.t", "f.key", "fp")
    large = once.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > (FILE if most is None else most)).select("t", "key", F.lit(True).alias("large"))
    once = once.join(large, ["t", "key"], "left")
    plain = once.where("large is null").select("t", "key", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("rest"), "fp")
    again = once.where("large").select("t", "key", "fp", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sub"))
    mask = F.element_at(F.array(*map(F.lit, second)), F.col("t") * n + F.col("sub"))
    return plain.unionAll(again.select("t", "key", "sub", F.col("fp").bitwiseAND(mask).alias("rest"), "fp"))


def links(fps: DataFrame, radius: int = RADIUS, parts: int = BLOCKS, most: int | None = None) -> DataFrame:
    """(a, b) links between the distinct fingerprints in fps(fp) that span each class of near ones."""
    file = ["t", "key", "sub", "rest"]
    dealt = filed(fps, radius, parts, most).repartition(partitions(fps), *file).sortWithinPartitions(*file, "fp")

    def other(a: list[np.ndarray], i: int | slice, b: list[np.ndarray], j: int | slice) -> np.ndarray:
        return np.any([x[i] != y[j] for x, y in zip(a, b, strict=True)], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(rows: list) -> Iterator[pa.RecordBatch]:
            *name, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            group = np.cumsum(np.r_[0, other(name, slice(1, None), name, slice(-1))])
            a, b = linked(group, fp.view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            *name, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*file, "fp"))
            cut = int(np.flatnonzero(np.r_[True, other(name, slice(1, None), name, slice(-1))])[-1])
            same = not held or not other(held[-1][:-1], -1, name, 0)
            if cut == 0 and same:  # the file goes on
                held.append((*name, fp))
                continue
            yield from emit([*held, (*(x[:cut] for x in name), fp[:cut])])
            held = [(*(x[cut:] for x in name), fp[cut:])]
        if held:
            yield from emit(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest doc_id that the row reaches through links, its own included. Null
    or empty texts have fingerprint zero, linked like any other. Repeated rows repeat. Rows without
    doc_id count as members but give no id; where no member has one, component_id is null. An empty
    table gives no rows. Other columns are ignored.
    """
    fps = checkpointed(fingerprints(docs, shingle, seed))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(distinct.select("fp"), radius))
    named = distinct.join(label, distinct.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # written down, so that the joins with it are plain ones, of which a hot key is split among tasks
    smallest = checkpointed(named.groupBy("label").agg(F.min("least").alias("component_id")))
    by_fp = checkpointed(named.join(smallest, "label").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row for each class of near-duplicates: that of the smallest doc_id, of several
    such rows the one with the smallest text (null first). Rows without doc_id cannot be told apart
    and stay. Empty table: no rows. All columns are kept, whatever their names."""
    found = simhash_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    one = rows.join(found, "id").withColumn("n", first).where("n = 1").unionByName(rows.where("id is null").withColumn("n", F.lit(1)))
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns))

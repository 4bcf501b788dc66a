"""Substring dedup by suffix automata over shards of the repeated passages.

A window is so many consecutive words. Every window is filed under its minimizer - the least hash of
the short word sequences inside it - and consecutive windows with the same minimizer make a fragment,
so that equal windows always lie in fragments with the same minimizer, wherever they stand. Windows
that repeat can only be found under minimizers that several documents have; the distinct fragments
under each of those are the reference. They are dealt to tasks by minimizer: a shard's suffix
automaton has to be sent only to the fragments that may match in it, which are in the same task, and
not to all documents. Streaming every one of them through the automata gives, for each window, the
smallest document that its words occur in. The documents then take the windows out that a smaller
document has.

The automata read the words themselves. Hashes of the words only file fragments and name them; before a document loses a window of a fragment, a second digest of the fragment's bytes is
compared with that of the fragment which the automata read.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailrace.llm.common import blocks, partitions

#: Words of a window, and of the sequences that minimizers are taken from.
WINDOW, GRAM = 13, 5
#: Words of a reference shard; a minimizer with more is worked off shard by shard.
SHARD_WORDS = 50_000
#: Words of the fragments that a task holds before it works them off, at the next minimizer.
HELD_WORDS = 4_000
#: Stands for no document.
NONE = (1 << 63) - 1
#: Bytes that are cut into words at once.
STRETCH = 1 << 19
#: Bytes of a word that are summed, each times the number of its place; longer words are hashed one by one.
SUMMED = 64
TIMES = np.frombuffer(b"".join(blake2b(b"place %d" % i, digest_size=8).digest() for i in range(SUMMED)), dtype=np.uint64)
GRAM_BASE, FRAGMENT_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2^64, for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def stretches(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each pair, by prefix sums of the values times powers."""
    size = 1 << max(10, int(len(values)).bit_length())
    up, down = powers(base, size)
    total = np.r_[np.uint64(0), np.cumsum(values * up[: len(values)], dtype=np.uint64)]
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def digest(fragment: bytes) -> int:
    """Of a fragment's words, a space between them; independent of their hashes."""
    return int.from_bytes(blake2b(fragment, digest_size=8, person=b"fragment").digest(), "little", signed=True)


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word, in order."""
    out, at = [], 0
    while at < len(text):
        cut = len(text)
        if cut - at > STRETCH:  # up to a separator, or the end of a very long word
            part = np.frombuffer(text, dtype=np.uint8, count=STRETCH, offset=at)
            apart = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            if len(apart):
                cut = at + int(apart[-1]) + 1
            else:
                cut = min((i for i in (text.find(bytes([c]), at + STRETCH) for c in b" \t\n\x0b\x0c\r") if i >= 0), default=len(text))
        b = np.frombuffer(text, dtype=np.uint8, count=cut - at, offset=at)
        apart = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
        edge = np.flatnonzero(apart[1:] != apart[:-1])
        start, end = edge[::2], edge[1::2]
        size = end - start
        begin = np.zeros(len(b), dtype=np.int64)
        begin[start] = start
        place = np.arange(len(b)) - np.maximum.accumulate(begin)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(TIMES[place & (SUMMED - 1)] * (b.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
        found = mixed(total[end] - total[start] + size.astype(np.uint64) * np.uint64(GRAM_BASE))
        for i in np.flatnonzero(size > SUMMED).tolist():
            found[i] = int.from_bytes(blake2b(text[at + start[i] : at + end[i]], digest_size=8).digest(), "little")
        out.append(found)
        at = cut
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def fragments(words: np.ndarray, document: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first word, number of windows, minimizer, hash) of each fragment; document numbers the words' documents."""
    n = len(words) - window + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < 1:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = np.zeros(len(words) - gram + 1, dtype=np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(GRAM_BASE) + words[j : len(grams) + j]
    grams = mixed(grams)
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, window - gram + 1):
        lower = grams[j : n + j] < least
        least[lower] = grams[j : n + j][lower]
        place[lower] = np.flatnonzero(lower) + j
    inside = document[:n] == document[window - 1 :]
    first = inside & np.r_[True, ~inside[:-1] | (place[1:] != place[:-1]) | (document[1:n] != document[: n - 1])]
    start = np.flatnonzero(first)
    total = np.cumsum(inside)
    ends = np.r_[start[1:], n]
    count = total[ends - 1] - total[start] + 1  # windows that follow until the next fragment
    return start, count, least[start], stretches(words, start, start + count + window - 1, FRAGMENT_BASE)


class SuffixAutomaton:
    """Of several word sequences; low is the smallest document of each state."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [NONE]

    def add(self, words: list[Hashable], document: int) -> None:
        nexts, link, length, low = self.next, self.link, self.length, self.low
        last = 0
        for c in words:
            to = nexts[last].get(c)
            if to is not None and length[to] == length[last] + 1:
                last = to
            else:
                if to is None:
                    new = len(nexts)
                    nexts.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    low.append(NONE)
                    p = last
                    while p >= 0 and c not in nexts[p]:
                        nexts[p][c] = new
                        p = link[p]
                    if p >= 0:
                        q = nexts[p][c]
                        link[new] = q if length[q] == length[p] + 1 else self.split(p, q, c)
                    last = new
                else:
                    last = self.split(last, to, c)
            if document < low[last]:
                low[last] = document

    def split(self, p: int, q: int, c: Hashable) -> int:
        nexts, link, length = self.next, self.link, self.length
        twin = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.low.append(NONE)
        link[q] = twin
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = twin
            p = link[p]
        return twin

    def finish(self) -> None:
        """Hands each state's smallest document to the shorter endings of the same words."""
        low, link = self.low, self.link
        for s in sorted(range(1, len(low)), key=self.length.__getitem__, reverse=True):
            if low[s] < low[link[s]]:
                low[link[s]] = low[s]

    def lows(self, words: list[Hashable], window: int) -> list[int]:
        """For each window of the words the smallest document that it occurs in (NONE: in none), from
        the matching statistics: the longest ending of what was read that occurs."""
        nexts, link, length, low = self.next, self.link, self.length, self.low
        state = matched = 0
        out = []
        for i, c in enumerate(words):
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(c)
            if to is not None:
                state, matched = to, matched + 1
            while state and length[link[state]] >= window:
                state = link[state]
            if matched > length[state]:
                matched = length[state]
            if i >= window - 1:
                out.append(low[state] if matched >= window else NONE)
        return out


def smallest(found: list[tuple[list[Hashable], int]], window: int, shard_words: int = SHARD_WORDS) -> list[list[int]]:
    """For each (words, document) the smallest document of each window among all of them."""
    out: list[list[int]] = []
    at = 0
    while at < len(found):
        shard, held = SuffixAutomaton(), 0
        while at < len(found) and held < shard_words:
            shard.add(*found[at])
            held += len(found[at][0])
            at += 1
        shard.finish()
        lows = [shard.lows(words, window) for words, _ in found]
        out = [list(map(min, a, b)) for a, b in zip(out, lows, strict=True)] if out else lows
    return out


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, document numbers) of all texts."""
    of = [word_hashes(t) for t in texts]
    return (np.concatenate(of) if of else np.zeros(0, dtype=np.uint64)), np.repeat(np.arange(len(of)), [len(h) for h in of])


def repeated_windows(docs: DataFrame, held: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, found): the fragments of each document that have windows which a smaller document has too:
    their names, the digests they have to have, and which windows these are, as bits. held: docs
    dealt by key, the doc_id."""
    n = partitions(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 2_000_000):
            ids = b.column("doc_id").to_numpy()
            words, document = batch_words([(t or "").encode() for t in b.column("text").to_pylist()])
            start, _, anchor, name = fragments(words, document, window, gram)
            # what a document repeats counts once
            of = document[start]
            order = np.lexsort((name, of))
            once = order[np.r_[True, (name[order][1:] != name[order][:-1]) | (of[order][1:] != of[order][:-1])][: len(order)]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[once].view(np.int64)), pa.array(name[once].view(np.int64)), pa.array(ids[of[once]])], names=["anchor", "fragment", "doc_id"])

    # without nulls no filter is put before one use of the exchange and not the other: it is made once
    whole = T.StructType([T.StructField(c, T.LongType(), False) for c in ("anchor", "fragment", "doc_id")])
    found = docs.where("doc_id is not null").mapInArrow(cut, whole).repartition(n, "anchor")
    distinct = found.groupBy("anchor", "fragment").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = distinct.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    mine = found.join(shared.select("anchor", "low"), "anchor").where("doc_id > low").select("anchor", "fragment", "doc_id")

    # the words of the distinct fragments, from the smallest document of each
    wanted = distinct.join(shared.select("anchor"), "anchor").groupBy(F.col("low").alias("key")).agg(F.collect_list("fragment").alias("wanted"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 2_000_000):
            ids, want = b.column("key").to_pylist(), b.column("wanted").to_pylist()
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            hashes, document = batch_words(texts)
            start, count, anchor, name = fragments(hashes, document, window, gram)
            name = name.view(np.int64)
            keep = np.isin(name, np.array([f for w in want for f in w], dtype=np.int64))
            first = np.searchsorted(document, np.arange(len(texts)))
            rows, at, words = [], -1, []
            sets = [set(w) for w in want]
            for s, c, a, f, d in zip(start[keep].tolist(), count[keep].tolist(), anchor[keep].view(np.int64).tolist(), name[keep].tolist(), document[start[keep]].tolist(), strict=True):
                if f in sets[d]:
                    sets[d].discard(f)
                    if d != at:
                        at, words, begin = d, texts[d].split(), int(first[d])
                    rows.append((a, f, ids[d], b" ".join(words[s - begin : s - begin + c + window - 1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "fragment", "low", "words"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, int, bytes]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            number: dict[bytes, int] = {}  # the words themselves tell them apart; small numbers stand for them in the automata
            anchors = [w[0] for w in waiting]
            alone = [(i == 0 or anchors[i - 1] != a) and (i + 1 == len(anchors) or anchors[i + 1] != a) for i, a in enumerate(anchors)]
            several = [([number.setdefault(x, len(number)) for x in w.split(b" ")], d) for (_, _, d, w), one in zip(waiting, alone, strict=True) if not one]
            rest = iter(smallest(several, window))
            # the automaton of a fragment alone under its minimizer is a path, which the fragment matches all along
            lows = [[d] * (w.count(b" ") + 2 - window) if one else next(rest) for (_, _, d, w), one in zip(waiting, alone, strict=True)]
            columns = [pa.array(c, pa.int64()) for c in ([w[0] for w in waiting], [w[1] for w in waiting], [digest(w[3]) for w in waiting])]
            return pa.RecordBatch.from_arrays([*columns, pa.array(lows, pa.list_(pa.int64()))], names=["anchor", "fragment", "digest", "lows"])

        for b in batches:
            for a, f, d, w in zip(*(b.column(c).to_pylist() for c in ("anchor", "fragment", "low", "words")), strict=True):
                if size >= HELD_WORDS and waiting[-1][0] != a:
                    yield emit()
                    waiting, size = [], 0
                waiting.append((a, f, d, w))
                size += w.count(b" ") + 1
        if waiting:
            yield emit()

    # the same columns as in the other use of the exchange
    reference = held.join(wanted, "key").select("key", "doc_id", "text", "wanted").mapInArrow(spell, "anchor long, fragment long, low long, words binary")
    lows = reference.repartition(n, "anchor").sortWithinPartitions("anchor", "fragment").mapInArrow(stream, "anchor long, fragment long, digest long, lows array<long>")
    several = mine.join(lows, ["anchor", "fragment"])
    bits = F.aggregate(F.transform("lows", lambda x, i: F.when(x < F.col("doc_id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    several = several.select("doc_id", "fragment", "digest", bits.alias("mask")).where("mask <> 0")
    return several.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("fragment", "digest", "mask")).alias("found"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, spans, kept), a row for each row of docs: spans are the maximal runs of words
    taken out (start from 0, n), kept the other words, joined by one space.

    A word goes if a window of `window` words around it also starts in a document with a smaller
    doc_id; windows are those of the input. Rows of equal doc_id do not take words from each other.
    Rows without doc_id neither give nor lose words. Null text has no words. Empty table: no rows.
    Other columns are ignored. A window has from gram to gram + 62 words: the windows of a fragment
    are the bits of a long.
    """
    if not 1 <= gram <= window <= gram + 62:
        raise ValueError("a window must have from gram to gram + 62 words")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # rows without doc_id are dealt by their text; they find nothing
    key = F.coalesce("doc_id", F.xxhash64("text")).alias("key")
    held = docs.select(key, "doc_id", "text").repartition(partitions(docs), "key")
    gone = repeated_windows(docs, held, window, gram)

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
        for b in blocks(batches, "text", 1_000_000):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            claims = [f if f and i is not None else None for i, f in zip(b.column("doc_id").to_pylist(), b.column("found").to_pylist(), strict=True)]
            # the fragments of the documents that may lose words
            of = [i for i, f in enumerate(claims) if f]
            hashes, document = batch_words([texts[i] for i in of])
            start, count, _, name = fragments(hashes, document, window, gram)
            name = name.view(np.int64)
            keep = np.isin(name, np.array([f["fragment"] for i in of for f in claims[i]], dtype=np.int64))
            first, where = np.searchsorted(document, np.arange(len(of))).tolist(), document[start[keep]]
            edge = np.searchsorted(where, np.arange(len(of) + 1)).tolist()
            mine = dict(zip(of, range(len(of)), strict=True))
            start, count, name = start[keep].tolist(), count[keep].tolist(), name[keep].tolist()
            rows = []
            for i, data in enumerate(texts):
                words = data.split()
                if not claims[i]:
                    rows.append((len(words), [], b" ".join(words)))
                    continue
                mask: dict[int, dict[int, int]] = {}  # by fragment and digest
                for f in claims[i]:
                    by_digest = mask.setdefault(f["fragment"], {})
                    by_digest[f["digest"]] = by_digest.get(f["digest"], 0) | f["mask"]
                step, d = [0] * (len(words) + 1), mine[i]
                for j in range(edge[d], edge[d + 1]):
                    if name[j] not in mask:
                        continue
                    s = start[j] - first[d]
                    m = mask[name[j]].get(digest(b" ".join(words[s : s + count[j] + window - 1])), 0)
                    if m == (1 << count[j]) - 1:  # all of its windows, which are one run of words
                        step[s] += 1
                        step[s + count[j] - 1 + window] -= 1
                        continue
                    for k in range(count[j] if m else 0):
                        if m >> k & 1:
                            step[s + k] += 1
                            step[s + k + window] -= 1
                covered = np.cumsum(np.array(step[:-1], dtype=np.int64)) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                spans = [{"start": int(s), "n": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)]
                gone = covered.tolist()
                rows.append((len(words), spans, b" ".join([w for w, c in zip(words, gone, strict=True) if not c])))
            kinds = (pa.int64(), span, pa.string())
            new = [pa.array([r[i].decode() for r in rows] if i == 2 else [r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *new], names=["doc_id", "n_words", "spans", "kept"])

    joined = held.join(gone, "key", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(take_out, "doc_id long, n_words long, spans array<struct<start:int,n:int>>, kept string")

"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens; the token sequences it accepts are those that merging yields. It starts
as one state with a loop for each base symbol. The merge rule (u, v) -> uv, in order of rank, adds
a gadget: wherever u can be read into a state that reads v, the token uv can be read into v's state,
and the state behind u is split off and loses v. So the state behind a token depends on that token
alone, and it was split off the state of the token's right part when the token's rule came.

A state's arcs are therefore given by the rules' ranks: an arc was added for each step of a token's
left side and stands unless a gadget had taken it away by then. The table of arcs (state, token) is
filled as they are first needed and kept. A word is encoded by walking the table along its symbols:
behind every symbol exactly one token can have been read last. Decoding writes the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.llm.common import blocks

#: Kept words and arcs of a worker process; beyond that the store is emptied and fills anew.
WORDS, ARCS = 250_000, 500_000
#: Bytes of text of one step.
TEXT_BYTES = 1_000_000
#: Keys of a path's tokens, inside a word and at its end.
INSIDE, LAST = 0, 1


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def narrowed(pattern: str) -> re.Pattern:
    """The pattern for texts of the first 256 signs, its classes written out."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        signs = "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(name, c))
        pattern = pattern.replace(name, signs)
    return re.compile(pattern)


def byte_letters() -> list[str]:
    """The letter of each byte: itself if printable, else one from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.ids, self.suffix = vocabulary, suffix
        self.labels: list[str] = [""] * (max(vocabulary.values(), default=-1) + 1)
        for label, i in vocabulary.items():
            self.labels[i] = label
        self.rank: dict[int, int] = {}  # of the rule (u, v), as u << 32 | v
        never = len(merges)
        self.left, self.right, self.made = ([-1] * len(self.labels) for _ in range(3))
        for rank, (u, v) in enumerate(merges):
            a, b, ab = vocabulary[u], vocabulary[v], vocabulary[u + v]
            self.rank.setdefault(a << 32 | b, rank)
            if self.made[ab] < 0:
                self.left[ab], self.right[ab], self.made[ab] = a, b, rank
        self.never = never
        # labels letter by letter; under INSIDE and LAST the token that ends there, without and with the suffix
        self.paths: dict = {}
        seen: dict[int, bool] = {}
        for label, i in vocabulary.items():
            last = bool(suffix) and label.endswith(suffix)
            letters, node = label[: -len(suffix)] if last else label, self.paths
            for c in letters:
                node = node.setdefault(c, {})
            if letters and self.whole(i, seen):
                node[LAST if last or not suffix else INSIDE] = i
                if not suffix:
                    node[INSIDE] = i
        self.arcs: dict[int, bool] = {}

    def arc(self, state: int, token: int) -> bool:
        """Whether the state behind one token reads the other. A gadget (y, v) took the arc v from the
        state behind y; the state behind a longer token has it from y if it was split off later, and
        the arc of a longer token comes from v's if it was added earlier."""
        y, split = state, self.never
        while y >= 0:
            v, grown = token, self.never
            while v >= 0:
                taken = self.rank.get(y << 32 | v, self.never)
                # of equal symbols in a row the left pair merges first: hence < and <=
                if taken < split and taken <= grown and taken < self.never:
                    return False
                v, grown = self.left[v], self.made[v]
            y, split = self.right[y], self.made[y]
        return True

    def encode(self, word: str) -> list[int]:
        """The tokens of one word, given as its bytes' letters."""
        n, arcs, paths = len(word), self.arcs, self.paths
        if len(arcs) > ARCS:
            arcs.clear()
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            state, node = last[start], paths
            if start and state < 0:
                continue
            for end in range(start + 1, n + 1):
                node = node.get(word[end - 1])
                if node is None:
                    break
                token = node.get(LAST if end == n else INSIDE)
                if token is None or last[end] >= 0:
                    continue
                if start:
                    key = state << 32 | token
                    ok = arcs.get(key)
                    if ok is None:
                        ok = arcs[key] = self.arc(state, token)
                    if not ok:
                        continue
                last[end], begin[end] = token, start
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError(f"no token ends at symbol {at} of a word")
            out.append(last[at])
            at = begin[at]
        return out[::-1]

    def whole(self, token: int, seen: dict[int, bool]) -> bool:
        """Whether merging a token's own symbols yields the token. seen: what is known of other tokens."""
        if token not in seen:
            seen[token] = self.made[token] < 0 or (self.whole(self.left[token], seen) and self.whole(self.right[token], seen) and self.joins(token))
        return seen[token]

    def joins(self, token: int) -> bool:
        """Whether the parts stay apart until the token's own rule joins them."""
        y, split = self.left[token], self.never
        while y >= 0:
            v, grown = self.right[token], self.never
            while v >= 0:
                taken = self.rank.get(y << 32 | v, self.never)
                if taken < split and taken <= grown and taken < self.made[token]:
                    return False
                v, grown = self.left[v], self.made[v]
            y, split = self.right[y], self.made[y]
        return True


class Tokenizer:
    """Text to ids and back, as the file describes: special strings are cut out first, then NFC, white
    space runs to one space, lower case, the split into words, bytes to letters, the automaton."""

    def __init__(self, description: dict) -> None:
        model = description["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {a["content"]: a["id"] for a in description.get("added_tokens", [])}
        labels = {i: s for i, s in enumerate(self.automaton.labels)} | {i: s for s, i in self.special.items()}
        self.labels = pa.array([labels.get(i, "") for i in range(max(labels) + 1)], pa.string())
        steps = description["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.narrow = narrowed(self.split.pattern)
        kinds = [s["type"] for s in description["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or description.get("decoder"):
            raise ValueError("this kind of tokenizer file is not supported")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if self.special else None
        self.letters, self.known = byte_letters(), {}

    def word(self, word: str) -> bytes:
        """The word's ids, four bytes each."""
        letters = self.letters
        if len(self.known) > WORDS:
            self.known.clear()
        out = self.known[word] = np.array(self.automaton.encode("".join([letters[b] for b in word.encode()])), dtype=np.int32).tobytes()
        return out

    def words(self, piece: str) -> list[str]:
        text = unicodedata.normalize("NFC", piece)
        # lower case letter by letter: no special form at the end of a word
        text = text.replace("Σ", "σ").lower()
        return (self.narrow if text.isascii() or latin(text) else self.split).findall(text)

    def plain(self, piece: str) -> bytes:
        known = self.known
        return b"".join([known.get(w) or self.word(w) for w in self.words(piece)])

    def ids(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids(text), dtype=np.int32).tolist()

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        of = [self.ids(t or "") for t in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in of)], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(of), dtype=np.int32))

    def decode_all(self, ids: pa.ListArray) -> pa.StringArray:
        """The labels of each list's arcs, a space between them; ids that are none give nothing, no
        ids or null an empty text."""
        return spelled(ids, self.labels)

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def spelled(ids: pa.ListArray, words: pa.StringArray) -> pa.StringArray:
    """words[id] of each list's ids, joined by a space."""
    ids = pc.fill_null(ids, []) if ids.null_count else ids
    flat, ends = ids.flatten(), np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy())].astype(np.int32)
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(words)))
    if not pc.all(known, min_count=0).as_py():
        keep = known.to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(keep)][ends].astype(np.int32)
        flat = flat.filter(known)
    return pc.binary_join(pa.ListArray.from_arrays(ends, words.take(flat)), " ")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One a worker process and file."""
    return Tokenizer(json.loads(Path(path).read_text(encoding="utf-8")))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of docs: the whole text's tokens, no special ones
    added. Null text counts as empty and has no tokens. path: a tokenizer file that every executor
    has. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in blocks(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), t.encode_all(b.column("text").to_pylist())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the text that the ids stand for. No or null ids: an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, t.decode_all(ids)], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def hexed(texts: pa.StringArray) -> pa.StringArray:
    """The SHA-256 of each text in UTF-8, lowercase hex."""
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts.cast(pa.binary())], pa.string())


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of what encode and decode return: the same calls in one
    stage, so that a task has one worker with the automaton and decoded texts stay in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in blocks(batches, "text", TEXT_BYTES):
            ids = t.encode_all(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), ids, hexed(t.decode_all(ids))], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode and decode return: the same calls,
    in one stage, so that neither ids nor decoded texts leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        decimal = pa.array(map(str, range(len(t.labels))), pa.string())
        for b in blocks(batches, "text", TEXT_BYTES):
            ids = t.encode_all(b.column("text").to_pylist())
            shas = [hexed(texts) for texts in (spelled(ids, decimal), t.decode_all(ids))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), *shas], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

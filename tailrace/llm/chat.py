"""Chat formatting with a prefix tree.

Every turn becomes one formatted piece; a conversation is a path of pieces. The distinct paths are
range-sorted, so that what shares initial turns stands together, and are packed in that order: each
piece that a path shares with the one before it is there already, the rest is appended. A pack is
thus a forest, written depth-first; pieces that its first path shares with the last one of the pack
before stay where they are and are named as what stands above the pack. So each piece of the tree of
all conversations is written once. A piece's node carries the position id of its first token - its
offset in the conversation, not in the pack - and what its tokens attend to: so many of the pieces
above the pack, and the intervals of the pack that its ancestors take, merged where they adjoin. A
token is a code point.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.llm.common import blocks, checkpointed, partitions, written

START, BODY, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Strings that may not stand inside a role or text; others' templates are kept out as well.
CONTROL = (START, BODY, END[:-1], "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
#: A pack takes no further conversation once it has so many code points.
PACK = 1 << 18
#: Letters of a turn's hash in a path's key.
HASH = 32

_rest = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
_in = re.compile(rf"([<\[])(\\*)(?={_rest})")
_out = re.compile(rf"([<\[])\\(\\*)(?={_rest})")
_turn = re.compile(rf"{re.escape(START)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    """text without control strings: a backslash more behind the first sign of each, and of whatever
    looks like one already escaped."""
    return _in.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _out.sub(r"\1\2", text)


def piece(role: str, text: str) -> str:
    return f"{START}{escape(role)}{BODY}{escape(text)}{END}"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _turn.findall(formatted)]


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
NODE = pa.struct([("id", pa.string()), *((n, pa.int32()) for n in ("start", "end", "parent", "depth")), ("position", pa.int64()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("above", pa.int32()), ("attention", pa.list_(SPAN)), ("conversation", pa.string())])
NODE_SQL = "struct<id:string,start:int,end:int,parent:int,depth:int,position:long,loss_start:int,loss_end:int,above:int,attention:array<struct<start:int,end:int>>,conversation:string>"


def node_id(key: str, depth: int) -> str:
    """Of the piece at a depth (from 0) of a path: a hash of all of the path down to it."""
    return hashlib.sha256(key[: HASH * (depth + 1)].encode()).hexdigest()[:HASH]


def shared(a: str, b: str) -> int:
    """How many initial turns two paths have in common."""
    n = 0
    while n + HASH <= min(len(a), len(b)) and a[n : n + HASH] == b[n : n + HASH]:
        n += HASH
    return n // HASH


class Pack:
    """A forest under construction below the first `above` pieces of a path; stack is the path of its
    last conversation, below as many of these as the path goes through: used."""

    def __init__(self, key: str, above: int, pieces: list[str]) -> None:
        self.above = [node_id(key, i) for i in range(above)]
        self.below = [0, *accumulate(len(p) for p in pieces[:above])]  # where each of them begins, and what comes next
        self.text: list[str] = []
        self.size, self.nodes, self.stack, self.used = 0, [], [], above

    def add(self, name: str, key: str, depth: int, pieces: list[str], masks: list[tuple[int, int]]) -> None:
        """A conversation that shares `depth` pieces with the one before it."""
        self.used = min(self.used, depth)
        del self.stack[depth - self.used :]
        for at in range(depth, len(pieces)):
            p, (lo, hi) = pieces[at], masks[at]
            parent = self.nodes[self.stack[-1]] if self.stack else None
            seen = [dict(x) for x in parent["attention"]] if parent else []
            if parent and seen and seen[-1]["end"] == parent["start"]:
                seen[-1]["end"] = parent["end"]
            elif parent:
                seen.append({"start": parent["start"], "end": parent["end"]})
            node = {"id": node_id(key, at), "start": self.size, "end": self.size + len(p), "parent": self.stack[-1] if self.stack else -1, "depth": at}
            node["above"] = self.used
            node["position"] = parent["position"] + parent["end"] - parent["start"] if parent else self.below[self.used]
            node |= {"loss_start": self.size + lo, "loss_end": self.size + hi, "attention": seen, "conversation": None}
            self.stack.append(len(self.nodes))
            self.nodes.append(node)
            self.text.append(p)
            self.size += len(p)
        if self.stack:
            self.nodes[self.stack[-1]]["conversation"] = name


def mask(role: str, text: str) -> tuple[int, int]:
    """Where the tokens to learn lie in the piece: the assistant's text, without its end mark."""
    at = len(START) + len(escape(role)) + len(BODY)
    return (at, at + len(escape(text))) if role == "assistant" else (0, 0)


def members(conversations: DataFrame) -> DataFrame:
    """(conv_id, conversation, key, turns): turns in order, key their hashes one after the other."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    c = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    part = lambda t: F.substring(F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256), 1, HASH)
    c = c.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"), F.array_join(F.transform("turns", part), "").alias("key"))
    return c.select("conv_id", F.md5(F.col("key").cast("binary")).alias("conversation"), "key", "turns")


def packs(members: DataFrame, most: int = PACK) -> DataFrame:
    """(pack, above, text, nodes): the distinct conversations as packed prefix trees. Nodes are in
    depth-first order; parent is a node of the pack, or -1; conversation names the one that ends at
    the node, if one does; above are the ids of the pieces of other packs that the first path begins
    with, and a node's own above how many of them its path goes through."""
    one = members.groupBy("conversation", "key").agg(F.any_value("turns").alias("turns"))
    # written down: a partition must not change its place in the order once the one behind it has looked at it
    one = checkpointed(one.repartitionByRange(partitions(members), "key").sortWithinPartitions("key"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for b in batches:
            key = b.column("key")[b.num_rows - 1].as_py() if b.num_rows else key
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([key])], names=["part", "key"])

    # one path a partition
    ends = sorted((r["part"], r["key"]) for r in one.select("key").mapInArrow(last, "part int, key string").collect())
    before = {part: ends[i - 1][1] for i, (part, _) in enumerate(ends) if i}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, name, path = None, "", before.get(TaskContext.get().partitionId(), "")

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack.above], pa.list_(pa.string())), pa.array(["".join(pack.text)]), pa.array([pack.nodes], pa.list_(NODE))], names=["pack", "above", "text", "nodes"])

        for b in batches:
            for conversation, key, turns in zip(*(b.column(c).to_pylist() for c in ("conversation", "key", "turns")), strict=True):
                pieces = [piece(t["role"], t["text"]) for t in turns]
                depth = shared(path, key)
                if pack is not None and pack.size >= most:
                    yield row()
                    pack = None
                if pack is None:
                    pack, name = Pack(key, depth, pieces), conversation
                pack.add(conversation, key, depth, pieces, [mask(t["role"], t["text"]) for t in turns])
                path = key
        if pack is not None:
            yield row()

    return written(one.select("conversation", "key", "turns").mapInArrow(run, f"pack string, above array<string>, text string, nodes array<{NODE_SQL}>"), "packs")


def pieces_above(packs: DataFrame) -> DataFrame:
    """(pack, pieces): the pieces above each pack that has some, in order, as (at, text, loss)."""
    wanted = packs.select("pack", F.posexplode("above").alias("at", "id"))
    nodes = packs.select("pack", F.explode(F.transform("nodes", lambda n: F.struct(n["id"], n["start"], n["end"], n["loss_start"], n["loss_end"]))).alias("n"))
    owners = nodes.join(wanted.select("id").distinct(), F.col("n.id") == F.col("id"), "left_semi").groupBy("pack").agg(F.collect_list("n").alias("found"))
    cut = lambda lo, hi: F.substring(F.col("text"), F.col(lo) + 1, F.col(hi) - F.col(lo))
    texts = packs.select("pack", "text").join(owners, "pack").select("text", F.explode("found").alias("n")).select("n.*", "text").select("id", cut("start", "end").alias("text"), cut("loss_start", "loss_end").alias("loss"))
    return wanted.join(texts, "id").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("at", "text", "loss"))).alias("pieces"))


def read_back(packs: DataFrame) -> DataFrame:
    """(conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each
    conversation in the packs, from their texts, parents, positions and loss intervals alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in blocks(batches, "text"):
            rows = []
            for text, nodes, above in zip(*(b.column(c).to_pylist() for c in ("text", "nodes", "pieces")), strict=True):
                for last in nodes:
                    if last["conversation"] is None:
                        continue
                    path, at = [last], last["parent"]
                    while at >= 0:
                        path.append(nodes[at])
                        at = nodes[at]["parent"]
                    path.sort(key=lambda n: n["position"])
                    first = (above or [])[: last["above"]]
                    formatted = "".join([x["text"] for x in first] + [text[n["start"] : n["end"]] for n in path])
                    turns = turns_of(formatted)
                    loss = "".join([unescape(x["loss"]) for x in first] + [unescape(text[n["loss_start"] : n["loss_end"]]) for n in path])
                    whole = "".join([f"{r}\n{t}\n" for r, t in turns])
                    rows.append((last["conversation"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    whole = packs.select("pack", "text", "nodes").join(pieces_above(packs), "pack", "left").select("text", "nodes", "pieces")
    return whole.mapInArrow(run, "conversation string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_format(conversations: DataFrame, most: int = PACK) -> tuple[DataFrame, DataFrame]:
    """(members, packs): which conversation each conv_id is, and the packed prefix trees.

    Rows of one conv_id are its turns, ordered by turn (null first), of equal turns by role and text;
    repeated rows are turns of their own. Null roles and texts count as empty. Rows without conv_id
    form one conversation. Equal conversations are packed once, however many there are, and each
    initial run of turns is written once, whatever pack it is in. Empty table: no members, no packs.
    Other columns are ignored.
    """
    rows = members(conversations)
    return rows.select("conv_id", "conversation"), packs(rows, most)

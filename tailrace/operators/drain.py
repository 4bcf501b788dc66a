"""Template mining after Drain (He et al. 2017), one tree for each service and number of tokens.

The number of tokens is the first level of Drain's tree, so dealing by it loses nothing; dealing by
service as well keeps services apart. Inside a deal rows come in order of ts and _id. Distinct masked
messages are mined, not rows, so a hot message is one row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.masks import masked, with_templates

ANY = "<*>"


class Miner:
    def __init__(self, similarity: float = 0.4, depth: int = 4, children: int = 100) -> None:
        self.similarity, self.depth, self.children = similarity, max(1, depth - 2), children
        self.tree: dict = {}

    def leaf(self, tokens: list[str]) -> list:
        node = self.tree
        for t in tokens[: self.depth]:
            t = ANY if any(c.isdigit() for c in t) else t
            if t not in node and len(node) >= self.children:
                t = ANY
            node = node.setdefault(t, {})
        return node.setdefault("\0", [])

    def add(self, tokens: list[str]) -> list[str]:
        """The group's template (a list that later members change) that the tokens join."""
        groups = self.leaf(tokens)
        best, score = None, (-1.0, -1)
        for g in groups:
            same = sum(a == b for a, b in zip(g, tokens, strict=True) if a != ANY)
            s = (same / max(len(tokens), 1), g.count(ANY))
            if s > score:
                best, score = g, s
        if best is None or score[0] < self.similarity:
            best = list(tokens)
            groups.append(best)
        else:
            best[:] = [a if a == b else ANY for a, b in zip(best, tokens, strict=True)]
        return best


def mine(logs: DataFrame, similarity: float = 0.4, depth: int = 4, children: int = 100, by: str | None = "service_name") -> DataFrame:
    """logs with template and template_id (templates by first appearance). Null services are one."""
    rows = logs.withColumn("__mask", masked(F.col("message")))
    service = F.coalesce(F.col(by), F.lit("")) if by else F.lit("")
    rows = rows.withColumn("__service", service)
    distinct = rows.groupBy("__service", "__mask").agg(F.min("ts").alias("first_ts"), F.min_by("_id", F.struct("ts", "_id")).alias("first_id"))
    distinct = distinct.withColumn("__n", F.size(F.split("__mask", r"\s+")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        miner = Miner(similarity, depth, children)
        pdf = pdf.sort_values(["first_ts", "first_id"])
        groups = [miner.add(m.split()) for m in pdf["__mask"]]
        return pdf[["__service", "__mask"]].assign(template=[" ".join(g) for g in groups])

    found = distinct.groupBy("__service", "__n").applyInPandas(grow, "__service string, __mask string, template string")
    out = rows.join(found, ["__service", "__mask"]).drop("__service", "__mask")
    first = out.groupBy("template").agg(F.min(F.struct("ts", "_id")).alias("first"))
    ids = first.select("template", F.row_number().over(Window.orderBy("first", "template")).alias("template_id"))
    return out.join(ids, "template")


def parse_logs(logs: DataFrame, algorithm: str = "drain", **how: float) -> DataFrame:
    """Templates by 'regex' masks or by 'drain' (also for names that are not known)."""
    return with_templates(logs) if algorithm == "regex" else mine(logs, **how)

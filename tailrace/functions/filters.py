"""Filters: a nested dictionary or list becomes one Column, so that it reaches the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailrace.schema import ERROR_LEVELS

OPERATORS = {
    "$gte": lambda c, v: c >= v, "$gt": lambda c, v: c > v, "$lte": lambda c, v: c <= v, "$lt": lambda c, v: c < v,
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(list(v)), "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}
OPERATORS |= {k: OPERATORS[f"${k}"] for k in ("gte", "gt", "lte", "lt")}
ERROR_WORDS = r"error|exception|fail|timeout|unable to"


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def compile_filter(spec: dict | list) -> Column:
    """All conditions of the dictionary (or of the dictionaries) together: path -> scalar (equal), list
    (any of), or {operator: value}. Operators mean what they say; timestamps compare as timestamps."""
    if isinstance(spec, list):
        return all_of([compile_filter(s) for s in spec])
    out = []
    for path, value in spec.items():
        column = F.col(path)
        if isinstance(value, dict):
            out += [OPERATORS[op](column, v if op in ("$in", "$exists") else F.lit(v).cast("timestamp") if path.endswith(("ts", "timestamp")) else F.lit(v)) for op, v in value.items()]
        else:
            out.append(column.isin(list(value)) if isinstance(value, (list, tuple, set)) else column.isNull() if value is None else column == value)
    return all_of(out)


def search_filter(start=None, end=None, services=None, levels=None, more: dict | None = None) -> dict:  # noqa: ANN001
    """The search API's arguments as one filter over canonical columns."""
    spec: dict = {}
    if start is not None or end is not None:
        spec["ts"] = {op: v for op, v in (("$gte", start), ("$lte", end)) if v is not None}
    return spec | ({"service_name": list(services)} if services else {}) | ({"log_level": list(levels)} if levels else {}) | (more or {})


def first_time(*paths: str) -> Column:
    """The first of several places of a timestamp that has one."""
    return F.coalesce(*(F.try_to_timestamp(F.col(p).cast("string")) for p in paths))


def is_error(columns: list[str]) -> Column:
    """Error rows: by level; where the table has no level, by words of the message."""
    if "log_level" in columns:
        return F.col("log_level").isin(*ERROR_LEVELS)
    return F.lower("message").rlike(ERROR_WORDS)


def terms_match(tokens: Column, terms: list[str], share: float = 0.3) -> Column:
    """Enough different terms are among the tokens: the share of them, rounded down, one at least."""
    least = max(1, int(len(set(terms)) * share))
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, dict.fromkeys(terms))))) >= least


def wildcard_match(text: Column, query: str) -> Column:
    """The query stands in the text as it is written; only texts of up to 256 characters are kept whole."""
    return (F.length(text) <= 256) & F.contains(text, F.lit(query))


def has_chinese(text: Column) -> Column:
    return text.rlike(r"[一-鿿]")

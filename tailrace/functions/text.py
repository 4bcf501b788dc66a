"""Text functions as Columns; Arrow functions only where Spark has no expression.

Patterns run with Unicode classes and Unix line ends, as the same patterns do elsewhere.
"""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGS = "(?Ud)"
# Patterns and words that decide results.
LEVEL_TAG = r"\[(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|ERR|TRACE)\]"
LEVEL_WORDS = (("ERROR", ("error", "exception")), ("WARN", ("warn",)), ("INFO", ("info",)), ("DEBUG", ("debug",)), ("TRACE", ("trace",)), ("FATAL", ("fatal",)))
TIME = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
MARKERS = ("Exception:", "Error:", "Traceback (most recent call last):")
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
CLEANING = {
    "urls": [(r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+(?:/[-\w%!./?=&]*)?", " [URL] ")],
    "paths": [(r"(?:/[-\w.]+)+(?:/[-\w.]+)*", " [PATH] ")],
    "ids": [(r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", " [UUID] "), (r"(?i)\b[0-9a-f]{24}\b", " [ID] ")],
    "ips": [(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", " [IP] ")],
    "dates": [(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[T ]\d{1,2}:\d{1,2}(?::\d{1,2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?", " [DATE] ")],
    "numbers": [(r"\b\d+(?:\.\d+)?\b", " [NUM] ")],
}
KEY_VALUES = (r"(\w+)=([^,\s]+)", r'(\w+):"([^"]*)"', r"(\w+):'([^']*)'", r"(\w+)->([^,\s]+)", r"(\w+)\s*:\s*([^,\s]+)")
FRAMEWORK_EXCEPTION = r"(Volo\.Abp\.[A-Za-z\.]+Exception)"
EXCEPTIONS = (
    ("abp_exception", r"(Volo\.Abp\.[A-Za-z\.]+Exception:.*?)(?=\s+---|\s+at\s+|$)"),
    ("system_exception", r"(System\.[A-Za-z\.]+Exception:.*?)(?=\s+---|\s+at\s+|$)"),
    ("java_exception", r"(java\.[A-Za-z\.]+Exception:.*?)(?=\s+at\s+|$)"),
    ("python_exception", r"(Traceback \(most recent call last\):[\s\S]*?(?:Error|Exception):.*?)(?=\n\n|\z)"),
    ("js_exception", r"(Error:.*?)(?=\s+at\s+|$)"),
    ("custom_exception", r"(CustomError:.*?)(?=\n|$)"),
)
STACKS = (r"(Exception:.*?)(?=\s+at\s+|\s+---|\z)", r"(Error:.*?)(?=\s+at\s+|\s+---|\z)", r"(Traceback \(most recent call last\):.*?)(?=\z)", r"(错误:.*?)(?=\s+在\s+|\z)", r"(异常:.*?)(?=\s+在\s+|\z)")
STOP_WORDS = {
    "en": ("a", "an", "the", "and", "or", "but", "if", "because", "as", "what", "is", "in", "into", "of", "for", "with", "by", "to", "from", "on", "at", "this", "that", "these", "those", "it", "its", "it's", "i", "my", "me", "mine", "we", "our", "ours", "you", "your", "yours", "he", "his", "him", "she", "her", "hers", "they", "their", "them", "be", "been", "being", "am", "are", "was", "were", "has", "have", "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may", "might", "must", "not", "no", "nor", "so"),
    "zh": ("的", "了", "和", "是", "就", "都", "而", "及", "与", "着", "或", "一个", "没有", "我们", "你们", "他们", "她们", "它们", "这", "那", "这个", "那个", "这些", "那些", "这样", "那样", "之", "得", "地", "在", "上", "下", "前", "后", "里", "外", "来", "去", "被", "把", "向", "让", "给", "的话", "说", "对于"),
}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, FLAGS + pattern, by)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: in a lambda an expression is worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def level_of(text: Column) -> Column:
    """The level a message names: its tag, else the first of the known words, else INFO; "" for ""."""
    tag, low = F.regexp_extract(text, LEVEL_TAG, 1), F.lower(text)
    guess = F.lit("INFO")
    for level, words in reversed(LEVEL_WORDS):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        guess = F.when(found, level).otherwise(guess)
    return F.when(text == "", "").when(tag != "", tag).otherwise(guess)


def time_of(text: Column) -> Column:
    return F.regexp_extract(text, FLAGS + TIME, 0)


def marker_at(text: Column) -> Column:
    """Where the first marker of the list that occurs begins (from 1), 0 if none does."""
    at = F.lit(0)
    for m in reversed(MARKERS):
        at = F.when(F.locate(m, text) > 0, F.locate(m, text)).otherwise(at)
    return at


def stack_trace(text: Column, depth: int = 30) -> Column:
    at = marker_at(text)
    tail = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")
    lines = F.split(tail, "\n", -1)
    return F.when(F.size(lines) > depth, F.concat(F.array_join(F.slice(lines, 1, depth), "\n"), F.lit("\n..."))).otherwise(tail)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def squeezed(text: Column) -> Column:
    return replaced(replaced(text, r"\s+", " "), r"^ | $", "")


def clean_message(text: Column, most: int = 10_000) -> Column:
    """The message before its exception, without colours, white space squeezed, at most so long."""
    at = marker_at(text)
    return F.substring(squeezed(strip_ansi(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text))), 1, most)


def exception_columns(text: Column) -> dict[str, Column]:
    """exception_type, _class and _message by the first pattern that matches; null if none does."""
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(EXCEPTIONS):
        hit = text.rlike(FLAGS + pattern)
        kind = F.when(hit, name).otherwise(kind)
        message = F.when(hit, F.regexp_extract(text, FLAGS + pattern, 1)).otherwise(message)
    return {"exception_type": kind, "exception_class": F.substring_index(message, ":", 1), "exception_message": message}


def regex_group(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match; empty where there is no text or no match."""
    return F.coalesce(F.regexp_extract(text, FLAGS + pattern, group), F.lit(""))


def framework_exception(text: Column) -> Column:
    """The full name of the framework's first exception in the text, else empty."""
    return regex_group(text, FRAMEWORK_EXCEPTION, 1)


def framework_module(exception: Column) -> Column:
    """The third part of an exception's dotted name, else empty."""
    return F.coalesce(F.get(F.split(exception, r"\."), F.lit(2)), F.lit(""))


def key_values(text: Column) -> Column:
    """Map of the pairs in five notations, ASCII keys only; a later notation and place wins."""
    pairs = [F.zip_with(F.regexp_extract_all(text, F.lit(FLAGS + p), F.lit(1)), F.regexp_extract_all(text, F.lit(FLAGS + p), F.lit(2)), lambda k, v: F.struct(k.alias("k"), v.alias("v"))) for p in KEY_VALUES]
    ascii_only = F.filter(F.concat(*pairs), lambda x: x["k"].rlike(r"^[\x00-\x7f]*$"))
    last = lambda found: F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found) + 1), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(once(ascii_only, last))


def clean_text(text: Column, **off: bool) -> Column:
    """Patterns by tags, in a fixed order: urls, paths, ids, ips, dates, numbers (off unless asked for),
    then white space. clean_text(c, urls=False) leaves URLs."""
    wanted = dict.fromkeys(CLEANING, True) | {"numbers": False, "whitespace": True} | off
    out = F.coalesce(text, F.lit(""))
    for kind, steps in CLEANING.items():
        if wanted[kind]:
            for pattern, tag in steps:
                out = replaced(out, pattern, tag)
    return squeezed(out) if wanted["whitespace"] else out


def cjk_pairs(text: Column) -> Column:
    """Pairs of neighbouring Chinese signs: the tokenizer where there is no segmenter."""
    runs = F.regexp_extract_all(text, F.lit(r"[一-鿿]+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))


def plain_words(text: Column, shortest: int = 2) -> Column:
    """Lower-cased words without punctuation and stop words."""
    words = F.split(F.lower(F.translate(text, PUNCTUATION, "")), FLAGS + r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(*STOP_WORDS["en"]))


def keywords(text: Column, language: str = "en", most: int = 10, shortest: int = 2) -> Column:
    """The most frequent words without stop words, ties in order of appearance."""
    words = F.filter(cjk_pairs(text), lambda w: (F.length(w) >= shortest) & ~w.isin(*STOP_WORDS["zh"])) if language == "zh" else plain_words(text, shortest)
    counted = lambda ws: F.transform(F.array_distinct(ws), lambda w: F.struct((-F.size(F.filter(ws, lambda x: x == w))).alias("n"), F.array_position(ws, w).alias("at"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(once(words, counted)), 1, most), lambda x: x["w"])


def chunks(text: Column, size: int = 512, overlap: int = 0) -> Column:
    """Array of pieces of `size` characters, each starting size - overlap after the one before."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text), F.lit(size - overlap)), lambda i: F.substring(text, i, F.lit(size))))


def language_of(text: Column) -> Column:
    return F.when(text.rlike(r"[一-鿿]"), "zh").when(text.rlike("[a-zA-Z]"), "en").otherwise("unknown")


def text_hash(text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.md5(text.cast("binary")))


def stack_of(text: Column, depth: int = 30) -> Column:
    """The stack trace by the first of five patterns, cut at `depth` lines with a remark."""
    found = F.lit("")
    for p in reversed(STACKS):
        got = F.regexp_extract(text, f"(?Uds){p}", 1)
        found = F.when(got != "", got).otherwise(found)
    lines = F.split(found, "\n", -1)
    return F.when(F.size(lines) > depth, F.concat(F.array_join(F.slice(lines, 1, depth), "\n"), F.lit("\n... (stack trace truncated)"))).otherwise(found)


def is_json(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), F.lit(False))


def preview(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Words, and one and a half for each Chinese sign."""
    return F.regexp_count(text, F.lit(FLAGS + r"\S+")) + 1.5 * F.regexp_count(text, F.lit(r"[一-鿿]"))


def length_penalty(text: Column) -> Column:
    chinese, english, digits = (F.regexp_count(text, F.lit(p)) for p in (r"[一-鿿]", "[a-zA-Z]", r"(?U)\d"))
    other = F.length(text) - chinese - english - digits - (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))))
    n = chinese * 1.5 + english + digits + other * 0.5
    return F.when(F.length(text) == 0, 0.5).when(n.between(100, 800), 1.0).when(n < 100, 0.8 + n / 100 * 0.2).when(n <= 1500, 0.9).otherwise(F.greatest(F.lit(0.6), 1.0 - (n - 1500) / 3000))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form; Spark has no expression for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def similarity_to(query: str):  # noqa: ANN201
    """A column function: difflib's ratio of each lower-cased text and the query."""

    @F.pandas_udf("double")
    def ratio(text: pd.Series) -> pd.Series:
        return text.map(lambda t: difflib.SequenceMatcher(None, query.lower(), (t or "").lower()).ratio())

    return ratio


@F.pandas_udf(T.DoubleType())
def pair_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def sentence_pieces(text: str, size: int = 512, overlap: int = 128) -> list[str]:
    """Sentences packed into pieces of at most `size`, the end of one repeated in the next."""
    if len(text) <= size:
        return [text] if text else []
    out, held = [], ""
    for s in re.split(r"(?<=[.!?。！？])\s+", text):
        if len(s) > size:
            out += ([held] if held else []) + [s[i : i + size] for i in range(0, len(s), size - overlap) if s[i : i + size]]
            held = ""
        elif len(held) + len(s) > size:
            out.append(held)
            held = (held[-overlap:] if 0 < overlap < len(held) else "") + s
        else:
            held = f"{held} {s}" if held else s
    return out + [held] if held else out


def sentence_chunks(size: int = 512, overlap: int = 128):  # noqa: ANN201
    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sentence_pieces(t or "", size, overlap))

    return cut


def json_objects(text: str) -> dict:
    """All outermost {...} of the text that are JSON objects, merged; later keys win."""
    out, depth, start, quoted, skip = {}, 0, 0, False, False
    for i, c in enumerate(text):
        if skip or (quoted and c == "\\"):
            skip = not skip
        elif depth and c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            start, depth = (i, 1) if not depth else (start, depth + 1)
        elif not quoted and c == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    found = json.loads(text[start : i + 1])
                except ValueError:
                    continue
                out |= found if isinstance(found, dict) else {}
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def find_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: {k: v if isinstance(v, str) else json.dumps(v) for k, v in json_objects(t or "").items()})


def phrase_within(terms: list[str], slop: int = 2):  # noqa: ANN201
    """A column function of token arrays: the terms in order with at most `slop` moves in all."""

    def near(tokens: list[str]) -> bool:
        places = [[i for i, t in enumerate(tokens) if t == w] for w in terms]
        return all(places) and any(sum(abs(min((p - (first + k) for p in at), key=abs)) for k, at in enumerate(places)) <= slop for first in places[0])

    @F.pandas_udf("boolean")
    def match(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: near(list(t)) if t is not None else False)

    return match

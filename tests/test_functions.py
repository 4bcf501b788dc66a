"""Text, mask, time, filter and vector functions on hand-written rows."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tailrace.config import Config
from tailrace.functions import filters, masks, text, times, vectors
from tailrace.operators import prompting


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_levels(spark):
    rows = {"[WARN] error": "WARN", "[error] x": "ERROR", "an Exception": "ERROR", "warning": "WARN", "information": "INFO", "debug": "DEBUG", "stacktrace": "TRACE", "fatal": "FATAL", "x": "INFO", "": "", "[ERR] y": "ERR"}
    assert values(spark, rows, text.level_of) == list(rows.values())


def test_stack_and_clean(spark):
    long = "Error: x\n" + "\n".join(f" at f{i}" for i in range(40))
    got = values(spark, ["a  b\tException: boom\n at f", long, "\x1b[31mred\x1b[0m  text ", "Traceback (most recent call last):\n  x", ""], text.stack_trace)
    assert got[0] == "Exception: boom\n at f" and got[1].count("\n") == 30 and got[1].endswith("...") and got[2] == "" and got[3].startswith("Traceback")
    assert values(spark, ["a  b\tException: boom", "\x1b[31mred\x1b[0m  text ", "Error: only"], text.clean_message) == ["a b", "red text", ""]


def test_exceptions(spark):
    rows = ["System.IO.FileException: gone at f", "java.lang.NullException: npe\n at g", "Volo.Abp.UserException: no --- x", "Traceback (most recent call last):\n  f\nValueError: bad\n\nmore", "TypeError: x at y", "CustomError: z", "fine"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", *(c.alias(n) for n, c in text.exception_columns(F.col("t")).items())).orderBy("i").collect()
    assert [r.exception_type for r in got] == ["system_exception", "java_exception", "abp_exception", "python_exception", "js_exception", "js_exception", None]
    assert (got[0].exception_class, got[0].exception_message) == ("System.IO.FileException", "System.IO.FileException: gone") and got[6].exception_class is None


def test_key_values(spark):
    got = values(spark, ["a=1, b:\"x y\" c:'z' d->4 e: 5 a=2", "naïve=1 ok=é", ""], text.key_values)
    assert got[0] == {"a": "2", "b": '"x', "c": "'z'", "d": "4", "e": "5"} and got[1] == {"ok": "é"} and got[2] == {}


def test_clean_text(spark):
    t = "see https://a.b/c?x=1 /usr/lib/x.so 123e4567-E89B-12d3-a456-426614174000 0123456789abcdef01234567 10.0.0.1 2024-01-02T03:04:05Z 42"
    assert values(spark, [t, "", None], text.clean_text) == ["see [URL] [PATH] [UUID] [ID] [IP] [DATE] 42", "", ""]
    assert values(spark, [t], lambda c: text.clean_text(c, numbers=True, urls=False, paths=False)) == ["see https://a.b/c?x= [NUM] /usr/lib/x.so [UUID] [ID] [IP] [DATE] [NUM]"]


def test_keywords_and_languages(spark):
    assert values(spark, ["The cat, the dog; a CAT dog bird", "", "数据库错误数据"], lambda c: text.keywords(c, most=2)) == [["cat", "dog"], [], ["数据库错误数据"]]
    assert values(spark, ["数据库数据"], lambda c: text.keywords(c, "zh")) == [["数据", "据库", "库数"]]
    assert values(spark, ["数 a", "abc", "12"], text.language_of) == ["zh", "en", "unknown"]
    assert values(spark, ["ｆｕｌｌ①"], text.nfkc) == ["full1"]


def test_chunks(spark):
    assert values(spark, ["abcdefg", "", "ab"], lambda c: text.chunks(c, 3, 1)) == [["abc", "cde", "efg", "g"], [], ["ab"]]
    assert text.sentence_pieces("One two. Three four! " * 3, 24, 4)[0] == "One two. Three four!"
    assert values(spark, ["x" * 20, ""], text.sentence_chunks(8, 2)) == [["xxxxxxxx", "xxxxxxxx", "xxxxxxxx", "xx"], []]


def test_json(spark):
    assert values(spark, ['a {"x": 1, "y": {"z": "}"}} b {"x": "2"} {broken', ""], text.find_json) == [{"x": "2", "y": '{"z": "}"}'}, {}]
    assert values(spark, ['{"a":1}', "[1]", "x", "", None], text.is_json) == [True, True, False, False, False]


def test_length_penalty(spark):
    assert values(spark, ["", "a" * 50, "a" * 100, "a" * 1000, "a" * 2000, "a" * 9000], text.length_penalty) == pytest.approx([0.5, 0.9, 1.0, 0.9, 1 - 500 / 3000, 0.6])


MASKED = ["from 10.0.0.1 on 2024-01-02 at 03:04:05.678", "12 took 125ms, 7 left 9", "C:\\dir\\my file.txt", "open /usr/lib my/x: 'it''s' \"q\\\"r\"", "id 123e4567-e89b-12d3-a456-426614174000"]


def test_masks(spark):
    want = []
    for t in MASKED:
        for pattern, tag in masks.MASKS:
            t = re.sub(pattern, tag, t)
        want.append(t)
    assert values(spark, MASKED, masks.masked) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="a1 .:/-'\"\\\n\u00e9\u0085\u00a0\u2028", max_size=30), min_size=40, max_size=40))
def test_masks_like_python(spark, texts):
    want = []
    for t in texts:
        for pattern, tag in masks.MASKS:
            t = re.sub(pattern, tag, t)
        want.append(t)
    assert values(spark, texts, masks.masked) == want


def test_times(spark):
    moments = [dt.datetime(2024, 1, d, h, m) for d, h, m in ((7, 12, 0), (8, 8, 59), (8, 9, 0), (8, 17, 59), (8, 18, 0))]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, ts timestamp_ntz").select("i", F.col("ts").cast("timestamp").alias("ts"))
    got = df.select("i", *(c.alias(n) for n, c in times.calendar(F.col("ts")).items()), F.unix_seconds(times.floor_to(F.col("ts"), 3600)).alias("b")).orderBy("i").collect()
    assert [r.business for r in got] == [False, False, True, True, False] and [r.weekend for r in got] == [True] + [False] * 4 and [r.weekday for r in got] == [6, 0, 0, 0, 0]
    assert all(r.b % 3600 == 0 for r in got)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", {"x": "p"}), (2, "b", {"x": "q"}), (3, None, {})], "n int, s string, m map<string,string>")
    ids = lambda spec: [r.n for r in df.where(filters.compile_filter(spec)).orderBy("n").collect()]
    assert ids({"n": {"$gt": 1, "$lte": 3}}) == [2, 3] and ids({"s": ["a", "b"]}) == [1, 2] and ids({"s": {"$ne": "a"}}) == [2] and ids({"m.x": "q"}) == [2]
    assert ids([{"n": {"gte": 2}}, {"s": None}]) == [3] and ids({}) == [1, 2, 3] and ids({"s": {"$exists": False}}) == [3]


def test_phrase(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "x", "x", "b"]), (2, ["a", "x", "x", "x", "b"]), (3, ["a"])], "i int, t array<string>")
    assert [r.v for r in df.select("i", text.phrase_within(["a", "b"], 2)("t").alias("v")).orderBy("i").collect()] == [True, True, False, False]


def test_vectors(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    assert [r.id for r in vectors.top_k(p, [1.0, 0.0], 2).collect()] == [1, 2]
    assert [(r.a, r.b) for r in vectors.neighbours(p, 0.9, block_rows=1).collect()] == [(1, 2)]
    got = {r.id: r.novel for r in vectors.novelty(p.where("id <> 1"), p.where("id = 1")).collect()}
    assert got == {2: False, 3: True, 4: True}
    made = spark.createDataFrame([("x",), (None,)], "t string").select(vectors.embedder()(F.col("t")).alias("v"), vectors.embedder(lambda t: 1 / 0)(F.col("t")).alias("z")).collect()
    assert len(made[0].v) == vectors.DIMENSION and set(made[0].z) == {0.0}


def test_query_analysis():
    f = prompting.query_features("数据库 connection timeout at 10.0.0.1")
    assert f["mixed"] and f["query_type"] == "performance_analysis" and f["ips"] == ["10.0.0.1"] and "connection" in f["english_keywords"]
    assert prompting.query_features("disk")["query_type"] == "keyword_search" and prompting.query_features("what is going on here")["query_type"] == "question_query"
    i = prompting.query_intent("why did the 服务A fail 10分钟前")
    assert i["query_type"] == "cause_analysis" and i["contains_time_reference"] and i["contains_service_reference"] and i["contains_error_reference"]
    assert prompting.expand_query("why", {"query_type": "cause_analysis"}).startswith("why cause")
    p = prompting.Prompts()
    assert not p.set("no placeholders") and p.set("{query}|{context}") and p.render("q", "c") == "q|c"


def test_config(tmp_path):
    c = Config.load(env={"LOG_AI_SEARCH__TOP_K": "7", "LOG_AI_NEW__FLAG": "TRUE", "LOG_AI_NEW__OFF": "no", "LOG_AI_NEW__GONE": "None"})
    assert c.get("new.off") is False and c.get("new.gone", 1) is None
    assert c.get("search.top_k") == 7 and c.get("new.flag") is True and c.get("a.b", 1) == 1
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json"), env={}).values == c.values

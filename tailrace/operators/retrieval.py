"""Hybrid search: a lexical and a vector leg, merged, scored and ranked as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.filters import compile_filter, has_chinese, terms_match, wildcard_match
from tailrace.functions.text import cjk_pairs, length_penalty, phrase_within, similarity_to
from tailrace.functions.times import freshness, seconds_between
from tailrace.functions.vectors import top_k
from tailrace.operators.prompting import RANKING_STOP_WORDS, query_features

K1, B = 1.2, 0.75
# Source weights, score weights and level importance by query type.
SOURCE_WEIGHTS = {"error_investigation": (0.5, 0.35, 0.15), "mixed_language_query": (0.4, 0.45, 0.15), "keyword_search": (0.6, 0.25, 0.15), "question_query": (0.25, 0.6, 0.15)}
SCORE_NAMES = ("base", "language", "keyword", "match", "tfidf", "other", "level_weight", "context_weight", "time_weight")
SCORE_WEIGHTS = {
    "error_investigation": (0.30, 0.20, 0.30, 0.10, 0.05, 0.05, 0.6, 0.3, 0.1),
    "performance_analysis": (0.25, 0.25, 0.25, 0.15, 0.05, 0.05, 0.4, 0.4, 0.2),
    "security_audit": (0.35, 0.20, 0.25, 0.10, 0.05, 0.05, 0.5, 0.3, 0.2),
    "mixed_language_query": (0.30, 0.35, 0.20, 0.10, 0.05, 0.00, 0.4, 0.4, 0.2),
    "keyword_search": (0.35, 0.15, 0.35, 0.10, 0.05, 0.00, 0.4, 0.4, 0.2),
    "question_query": (0.25, 0.40, 0.15, 0.10, 0.10, 0.00, 0.3, 0.5, 0.2),
    "general": (0.30, 0.30, 0.20, 0.10, 0.05, 0.05, 0.4, 0.4, 0.2),
}
# Words that tell a query about errors, and a question.
ERROR_TERMS, QUESTION_TERMS = ("error", "exception", "fail", "错误", "异常"), ("什么", "如何")
TECHNICAL_WEIGHTS = {"error_terms": 2.5, "api_terms": 1.8, "auth_terms": 1.8, "db_terms": 1.5, "timeout_terms": 2.0}
LEVEL_IMPORTANCE = {"FATAL": 1.0, "CRITICAL": 1.0, "ERROR": 0.9, "EXCEPTION": 0.9, "WARN": 0.7, "WARNING": 0.7, "INFO": 0.5, "DEBUG": 0.3, "TRACE": 0.2}


@dataclass
class Weights:
    es: float = 0.4
    vector: float = 0.4
    rerank: float = 0.2
    dynamic: bool = True
    history: list = field(default_factory=list)

    def set(self, es: float | None = None, vector: float | None = None, dynamic: bool | None = None) -> dict:
        """New weights, each between 0 and 1; what they were is kept."""
        if any(w is not None and not 0 <= w <= 1 for w in (es, vector)):
            raise ValueError("weights lie between 0 and 1")
        self.history.append((self.es, self.vector, self.rerank))
        self.es, self.vector = self.es if es is None else es, self.vector if vector is None else vector
        self.rerank = max(0.0, 1 - self.es - self.vector)
        self.dynamic = self.dynamic if dynamic is None else dynamic
        return {"es_weight": self.es, "vector_weight": self.vector, "rerank_weight": self.rerank}


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def ranking_words(text: Column) -> Column:
    """Words of more than two letters that are no stop words."""
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(RANKING_STOP_WORDS["en"])))


def bm25(docs: DataFrame, terms: list[str], k: int | None = 50, tokens: Column | None = None) -> DataFrame:
    """(id, score) of the k best documents(id, message) by BM25, of all that hold a term if k is None.
    Only the query's terms are exploded; lengths and frequencies are those of all of docs."""
    tokens = words(F.col("message")) if tokens is None else tokens
    terms = list(dict.fromkeys(terms))
    d = docs.select("id", tokens.alias("t")).select("id", F.size("t").alias("dl"), F.filter("t", lambda w: w.isin(*terms)).alias("t"))
    whole = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = d.where(F.size("t") > 0).select("id", "dl", F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), "term").join(F.broadcast(whole), F.lit(True))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = joined.groupBy("id").agg(F.sum(part).alias("score"))
    return scored if k is None else scored.orderBy(F.round("score", 9).desc(), "id").limit(k)


def lexical(docs: DataFrame, query: str, k: int = 50, where: Column | None = None) -> DataFrame:
    """The lexical leg over (id, message, timestamp, ...): documents that hold enough of the query's
    terms, the query as a phrase, or - for short queries - as it is written, by BM25 over all that the
    filter leaves, newest first among equals. What is found only as it is written scores 0."""
    docs = docs if where is None else docs.where(where)
    f = query_features(query)
    terms = list(dict.fromkeys([*f["english_keywords"], *f["chinese_keywords"]])) or query.lower().split()
    tokens = F.concat(words(F.col("message")), cjk_pairs(F.col("message")))
    hit = terms_match(tokens, terms)
    if len(query.split()) <= 2:
        hit = hit | wildcard_match(F.col("message"), query)
    if len(terms) > 1:
        hit = hit | (terms_match(tokens, terms, 1.0) & phrase_within(terms)(tokens))
    scored = docs.where(hit).join(bm25(docs, terms, None, tokens), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.orderBy(F.round("score", 9).desc(), F.col("timestamp").desc(), "id").limit(k)


def merge(lexical_hits: DataFrame, vector_hits: DataFrame, reranked: DataFrame | None = None, shared: list[str] | None = None) -> DataFrame:
    """Hits of both legs by id, missing scores 0; shared columns from the lexical leg where it has
    them. Scores of a reranker are joined to what is there; ids it alone has are dropped."""
    shared = shared or ["message", "log_level", "service_name", "timestamp"]
    a = lexical_hits.select("id", F.col("score").alias("es_score"), *shared)
    b = vector_hits.select("id", F.col("score").alias("vector_score"), *(F.col(c).alias(f"__{c}") for c in shared))
    out = a.join(b, "id", "full_outer").select("id", F.coalesce("es_score", F.lit(0.0)).alias("es_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), *(F.coalesce(c, f"__{c}").alias(c) for c in shared))
    if reranked is None:
        return out.withColumn("rerank_score", F.lit(0.0))
    return out.join(reranked.select("id", F.col("score").alias("rerank_score")), "id", "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def add_missing(first: DataFrame, more: DataFrame) -> DataFrame:
    """first and those of more whose id it lacks."""
    return first.unionByName(more.join(first.select("id"), "id", "left_anti"), allowMissingColumns=True)


def merge_with_reranked(lexical_hits: DataFrame, vector_hits: DataFrame, reranked: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """(id, scores, final_score) that also keeps ids only the reranker has."""
    parts = [d.select("id", F.col("score").alias(n)) for d, n in ((lexical_hits, "es_score"), (vector_hits, "vector_score"), (reranked, "rerank_score"))]
    out = parts[0].join(parts[1], "id", "full_outer").join(parts[2], "id", "full_outer").na.fill(0.0, ["es_score", "vector_score", "rerank_score"])
    return out.withColumn("final_score", sum((F.col(n) * w for n, w in zip(("es_score", "vector_score", "rerank_score"), weights, strict=True)), F.lit(0.0)))


def quality(hits: DataFrame) -> float:
    """The mean of the five best scores, 0 without hits."""
    return hits.orderBy(F.col("score").desc()).limit(5).agg(F.avg("score")).first()[0] or 0.0


def heuristic_weights(query: str, weights: Weights) -> tuple[float, float, float]:
    """(lexical, vector, reranker) by the query's form alone: short or about errors, long or a question,
    else as set; always as set where dynamic weights are off."""
    n, low = len(query.split()), query.lower()
    if weights.dynamic and (n <= 3 or any(t in low for t in ERROR_TERMS)):
        return 0.5, 0.3, 0.2
    if weights.dynamic and (n >= 5 or low.endswith("?") or any(t in low for t in QUESTION_TERMS)):
        return 0.2, 0.6, 0.2
    return weights.es, weights.vector, weights.rerank


def source_weights(kind: str, lexical_mean: float | None, vector_mean: float | None, base: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> tuple[float, float, float]:
    """Weights of the three sources by query type, moved by 0.1 towards a leg whose best scores are
    more than half as high again; they sum to 1."""
    e, v, r = SOURCE_WEIGHTS.get(kind, base)
    if lexical_mean is not None and vector_mean is not None:
        if lexical_mean > vector_mean * 1.5:
            e, v = min(0.7, e + 0.1), max(0.2, v - 0.1)
        elif vector_mean > lexical_mean * 1.5:
            e, v = max(0.2, e - 0.1), min(0.7, v + 0.1)
    total = e + v + r
    return (e / total, v / total, r / total) if total else (0.0, 0.0, 0.0)


def english_relevance(message: Column, terms: list[str]) -> Column:
    """0.7 of the share of terms among the words and 0.3 of half the share that only overlaps some."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(0.0)
    w = F.array_distinct(ranking_words(message))
    q = F.array(*map(F.lit, terms))
    exact = F.size(F.array_intersect(w, q)) / len(terms)
    partial = F.size(F.filter(q, lambda t: F.exists(w, lambda x: (x != t) & (F.contains(x, t) | F.contains(t, x))))) * 0.5 / len(terms)
    return F.when(F.size(w) == 0, 0.0).otherwise(F.least(F.lit(1.0), exact * 0.7 + partial * 0.3))


def chinese_relevance(message: Column, keywords: list[str], key_terms: list[str]) -> Column:
    if not keywords and not key_terms:
        return F.lit(0.0)
    text = F.array_join(F.regexp_extract_all(message, F.lit("[一-鿿]+"), F.lit(0)), "")
    w = F.array_distinct(cjk_pairs(text))
    k, t = (F.array(*map(F.lit, dict.fromkeys(x))).cast("array<string>") for x in (keywords, key_terms))
    overlap = F.size(F.array_intersect(w, k)) / max(1, len(set(keywords)))
    terms = F.size(F.filter(t, lambda x: F.contains(text, x))) / max(1, len(set(key_terms)))
    top = F.slice(w, 1, 10)
    jaccard = F.size(F.array_intersect(top, t)) / F.greatest(F.lit(1), F.size(F.array_union(top, t)))
    return F.when(text == "", 0.0).otherwise(F.least(F.lit(1.0), overlap * 0.4 + terms * 0.4 + jaccard * 0.2))


def mixed_relevance(chinese: Column, english: Column, ratios: tuple[float, float]) -> Column:
    total = sum(ratios)
    wc, we = (ratios[0] / total, ratios[1] / total) if total else (0.5, 0.5)
    base = chinese * wc + english * we
    return F.when((chinese > 0.3) & (english > 0.3), F.least(F.lit(1.0), base + F.least(chinese, english) * 0.2)).otherwise(base)


def weighted_terms(f: dict) -> list[tuple[str, float]]:
    out = [(w, 1.5) for w in f["chinese_keywords"]] + [(w, 2.0) for w in f["chinese_key_terms"]] + [(w, 1.0) for w in f["english_keywords"]]
    out += [(t.lower(), TECHNICAL_WEIGHTS[k]) for k, terms in f["technical"].items() for t in terms]
    return out + [(n, 1.2) for n in f["numbers"]] + [(ip, 2.0) for ip in f["ips"]]


def keyword_score(message: Column, terms: list[tuple[str, float]]) -> Column:
    """The share of the terms' weight that stands in the message."""
    if not terms:
        return F.lit(0.0)
    found = sum((F.when(F.contains(message, F.lit(t)) | F.contains(F.lower(message), F.lit(t)), w).otherwise(0.0) for t, w in terms), F.lit(0.0))
    return found / sum(w for _, w in terms)


def tfidf_tokens(text: Column) -> Column:
    chinese = F.filter(cjk_pairs(text), lambda t: (F.length(t) > 1) & ~t.isin(*sorted(RANKING_STOP_WORDS["zh"])))
    return F.concat(chinese, ranking_words(text), F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)))


def tfidf_cosine(hits: DataFrame, query: str, most: int = 1000) -> DataFrame:
    """(id, tfidf): cosine of the query's and each hit's tf-idf vector, over the hits and the query as
    the corpus; smooth idf, the `most` most frequent tokens."""
    spark = hits.sparkSession
    q = spark.range(1).select(F.lit(None).cast(hits.schema["id"].dataType).alias("id"), F.lit(query).alias("message"))
    docs = hits.select("id", "message").unionByName(q)
    tf = docs.select("id", F.explode(tfidf_tokens(F.col("message"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    tokens = tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.col("total").desc(), "token").limit(most)
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    w = tf.join(F.broadcast(tokens), "token").join(n, F.lit(True)).select("id", "token", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    mine = w.where("id is null").select("token", F.col("w").alias("qw"))
    qn = mine.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = w.where("id is not null").join(F.broadcast(mine), "token", "left").groupBy("id").agg(F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    return dots.join(F.broadcast(qn), F.lit(True)).select("id", F.coalesce(F.col("dot") / (F.col("dn") * F.col("qn")), F.lit(0.0)).alias("tfidf"))


def document_match(message: Column, level: Column, f: dict, similarity: Column | None = None) -> Column:
    query, low = f["query"], F.lower(message)
    n = F.length(message)
    ratio = F.least(n, F.lit(len(query))) / F.greatest(n, F.lit(max(len(query), 1)))
    chinese, english = has_chinese(message), message.rlike("[a-zA-Z]")
    language = F.lit(1.0)
    if f["has_chinese"]:
        language = language * F.when(chinese, 1.0).otherwise(0.7)
    if f["has_english"]:
        language = language * F.when(english, 1.0).otherwise(0.7)
    if f["mixed"]:
        language = language * F.when(chinese & english, 1.2).otherwise(1.0)
    up = F.upper(F.coalesce(level, F.lit("")))
    kind = {
        "error_investigation": F.when(up.isin("ERROR", "FATAL", "EXCEPTION"), 1.5).when(up.isin("WARN", "WARNING"), 1.2),
        "performance_analysis": F.when(low.rlike("timeout|slow"), 1.3),
        "security_audit": F.when(up.isin("WARN", "WARNING", "ERROR") & low.rlike("auth|permission|denied|forbidden"), 1.4),
    }.get(f["query_type"])
    kind = F.lit(1.0) if kind is None else F.coalesce(kind, F.lit(1.0))
    similarity = similarity_to(query)(message) if similarity is None else similarity
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), ratio * 0.2 + language * 0.3 + kind * 0.3 + similarity * 0.2))


def level_importance(level: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in LEVEL_IMPORTANCE.items() for x in p))[F.upper(F.coalesce(level, F.lit("")))], F.lit(0.5))


def context_scores(hits: DataFrame, near_seconds: float = 300, additive: bool = False) -> DataFrame:
    """hits with context_score: neighbours in time less than near_seconds apart raise each other, by up
    to a fifth; those of the same service by a further twentieth; scaled to at most 1. Hits are few
    (the legs' limits), so their order in time is one window."""
    w = Window.orderBy("timestamp", "id")

    def factor(ts: Column, service: Column) -> Column:
        gap = F.abs(seconds_between(F.col("timestamp"), ts))
        close = F.coalesce((gap < near_seconds), F.lit(False))
        if additive:
            return F.when(close, 1 - gap / near_seconds * 0.2).otherwise(0.0)
        return F.when(close, 1 + (1 - gap / near_seconds) * 0.2).otherwise(1.0) * F.when(ts.isNotNull() & (F.col("service_name") == service), 1.05).otherwise(1.0)

    both = [factor(go("timestamp").over(w), go("service_name").over(w)) for go in (F.lag, F.lead)]
    raw = 1.0 + both[0] + both[1] if additive else both[0] * both[1]
    scored = hits.withColumn("context_score", raw)
    top = F.max("context_score").over(Window.partitionBy())
    return scored.withColumn("context_score", F.when(top > 1, F.col("context_score") / top).otherwise(F.col("context_score")))


def time_relations(hits: DataFrame, near_seconds: float = 60) -> DataFrame:
    """hits with related: the neighbours in time less than near_seconds away, and how far (signed)."""
    w = Window.orderBy("timestamp", "id")
    sides = [F.struct(go("id").over(w).alias("id"), seconds_between(go("timestamp").over(w), F.col("timestamp")).alias("time_diff")) for go in (F.lag, F.lead)]
    return hits.withColumn("related", F.filter(F.array(*sides), lambda s: F.abs(s["time_diff"]) < near_seconds))


def relevance(message: Column, keywords: list[str]) -> tuple[Column, Column]:
    """(coverage of the keywords, high above 0.8, medium above 0.5, else low)."""
    n = len(keywords)
    found = sum((F.contains(F.lower(message), F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    share = found / n if n else F.lit(0.0)
    return share, F.when(share > 0.8, "high").when(share > 0.5, "medium").otherwise("low")


def ranked(hits: DataFrame, query: str, now: datetime | str, weights: tuple[float, float, float] | None = None, k: int = 20, similarity: Column | None = None) -> DataFrame:
    """Merged hits with every component, final_score and rank, the k best."""
    f = query_features(query)
    w = dict(zip(SCORE_NAMES, SCORE_WEIGHTS.get(f["query_type"], SCORE_WEIGHTS["general"]), strict=True))
    we, wv, wr = weights or source_weights(f["query_type"], None, None)
    m = F.coalesce(F.col("message"), F.lit(""))
    en, zh = english_relevance(m, f["english_keywords"]), chinese_relevance(m, f["chinese_keywords"], f["chinese_key_terms"])
    language = mixed_relevance(zh, en, (f["chinese_ratio"], f["english_ratio"])) if f["mixed"] else zh if f["primarily_chinese"] else en
    scored = context_scores(hits).join(tfidf_cosine(hits, query), "id", "left").withColumn("tfidf_score", F.coalesce("tfidf", F.lit(0.0))).drop("tfidf")
    scored = scored.withColumns(
        {
            "base_score": F.col("es_score") * we + F.col("vector_score") * wv + F.col("rerank_score") * wr,
            "language_score": language,
            "keyword_score": keyword_score(m, weighted_terms(f)),
            "query_doc_match": document_match(m, F.col("log_level"), f, similarity),
            "level_importance": level_importance(F.col("log_level")),
            "time_freshness": freshness(F.col("timestamp"), F.lit(now).cast("timestamp")),
            "length_penalty": length_penalty(m),
        }
    )
    other = F.col("level_importance") * w["level_weight"] + F.col("context_score") * w["context_weight"] + F.col("time_freshness") * w["time_weight"]
    final = (F.col("base_score") * w["base"] + F.col("language_score") * w["language"] + F.col("keyword_score") * w["keyword"] + F.col("query_doc_match") * w["match"] + F.col("tfidf_score") * w["tfidf"] + other * w["other"]) * F.col("length_penalty")
    scored = scored.withColumn("final_score", final).orderBy(F.round("final_score", 9).desc(), "id").limit(k)
    coverage, grade = relevance(m, [*f["english_keywords"], *f["chinese_keywords"]])
    rank = F.row_number().over(Window.orderBy(F.round("final_score", 9).desc(), "id"))
    return scored.withColumn("rank", rank).withColumn("keyword_coverage", coverage).withColumn("relevance", grade)


def search(docs: DataFrame, query: str, embedding: list[float] | None, now: datetime | str, filters: dict | None = None, max_results: int = 20, vector_levels: list[str] | None = None, reranker=None, weights: Weights | None = None, least: float = 0.5) -> dict:  # noqa: ANN001
    """Hybrid search over docs(id, message, log_level, service_name, timestamp, vector). Filters come
    before both legs' choice; vector_levels limits the vector leg's levels; reranker takes the thirty
    best and gives (id, score). Returns status, counts, total and the ranked hits."""
    if not query.strip():
        return {"status": "error", "message": "the query is empty", "results": None, "total": 0}
    where = compile_filter(filters) if filters else None
    a = lexical(docs, query, 50, where)
    points = docs if where is None else docs.where(where)
    points = points.where(F.col("log_level").isin(vector_levels)) if vector_levels else points
    b = top_k(points, embedding, 50, least) if embedding is not None else a.limit(0)
    merged = merge(a, b)
    scores = reranker(merged.orderBy(F.greatest("es_score", "vector_score").desc(), "id").limit(30), query) if reranker else None
    merged = (merge(a, b, scores) if scores is not None else merged).persist()
    total = merged.count()
    use = weights or Weights()
    kind = query_features(query)["query_type"]
    source = source_weights(kind, quality(a), quality(b)) if use.dynamic and embedding is not None else (use.es, use.vector, use.rerank)
    return {"status": "success", "query": query, "total": total, "results": ranked(merged, query, now, source, max_results)}

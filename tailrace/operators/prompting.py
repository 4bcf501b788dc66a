"""What is known of one query string, and the prompts built from results. Plain Python on one string;
only the context block reads rows, of which it takes the first few."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.text import STOP_WORDS, preview, token_estimate

# Word lists and patterns that decide a query's features and intent.
RANKING_STOP_WORDS = {
    "en": set(("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "be", "have", "has", "had", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these")),
    "zh": set(("的", "了", "和", "是", "在", "有", "我", "你", "他", "这", "那", "之", "与", "及", "其", "到", "以", "会", "也", "但", "对", "从", "而", "被", "把", "给", "让", "向", "往", "为", "所", "于", "就", "不", "都", "已", "可", "里", "去", "过", "她", "它", "个", "们", "来")),
}
TECHNICAL = {
    "error_terms": r"(?i)(error|exception|fail|crash|错误|异常|失败|崩溃)",
    "api_terms": r"(?i)(api|rest|http|request|response|请求|响应|接口)",
    "auth_terms": r"(?i)(auth|login|token|permission|认证|登录|权限|令牌)",
    "db_terms": r"(?i)(database|sql|query|transaction|数据库|查询|事务)",
    "timeout_terms": r"(?i)(timeout|slow|delay|超时|缓慢|延迟)",
}
TIME_WORDS = (r"昨天", r"今天", r"上周", r"前天", r"最近", r"(\d+)\s*(分钟|小时|天|周|月)前", r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})", r"(\d{1,2}:\d{2})")
SERVICE_WORDS = (r"服务[^,，。；]*", r"模块[^,，。；]*", r"系统[^,，。；]*", r"应用[^,，。；]*")
ERROR_WORDS = ("错误", "异常", "失败", "问题", "故障", "error", "exception", "fail", "issue", "bug")
INTENTS = (("cause_analysis", ("为什么", "原因", "why", "reason")), ("solution_seeking", ("怎么解决", "如何修复", "解决方案", "how to fix", "solution")), ("statistical", ("多少", "数量", "频率", "how many", "count", "frequency")))
EXPANSIONS = {"cause_analysis": ["cause", "reason", "原因"], "solution_seeking": ["solution", "fix", "resolve", "解决"]}
PROMPT = "Answer from these log excerpts only.\n\n{context}\n\nQuestion: {query}\n"
CUT = "...(内容已截断)"


def pairs(text: str) -> list[str]:
    """Neighbouring Chinese signs, where there is no segmenter."""
    return [r[i : i + 2] for r in re.findall(r"[一-鿿]+", text) for i in range(max(1, len(r) - 1))]


def query_features(query: str) -> dict:
    chinese, english = re.findall(r"[一-鿿]", query), re.findall(r"[a-zA-Z]", query)
    total = len(query.replace(" ", ""))
    f: dict = {"query": query, "has_chinese": bool(chinese), "has_english": bool(english), "chinese_ratio": len(chinese) / total if total else 0.0, "english_ratio": len(english) / total if total else 0.0}
    f["mixed"] = f["has_chinese"] and f["has_english"]
    f["primarily_chinese"], f["primarily_english"] = f["chinese_ratio"] > 0.6, f["english_ratio"] > 0.6
    f["chinese_keywords"] = list(dict.fromkeys(w for w in pairs(query) if len(w) > 1 and w not in RANKING_STOP_WORDS["zh"]))
    f["chinese_key_terms"] = f["chinese_keywords"][:5]
    f["english_keywords"] = [w for w in re.findall(r"[a-zA-Z]+", query.lower()) if len(w) > 2 and w not in RANKING_STOP_WORDS["en"]]
    f["numbers"], f["ips"], f["urls"] = re.findall(r"\d+", query), re.findall(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", query), re.findall(r"https?://[^\s]+", query)
    f["technical"] = {k: m for k, p in TECHNICAL.items() if (m := re.findall(p, query))}
    asks = "?" in query or any(w in query for w in ("什么", "如何", "为什么", "what", "how", "why"))
    rules = (("error_terms" in f["technical"], "error_investigation"), ("timeout_terms" in f["technical"], "performance_analysis"), ("auth_terms" in f["technical"], "security_audit"), (f["mixed"], "mixed_language_query"), (len(query.split()) <= 2, "keyword_search"), (asks, "question_query"))
    f["query_type"] = next((kind for holds, kind in rules if holds), "general")
    return f


def plain_keywords(text: str, most: int = 5) -> list[str]:
    words = [w for w in re.sub(r"[!-/:-@\[-`{-~]", "", text).lower().split() if len(w) >= 2 and w not in STOP_WORDS["en"]]
    return sorted(dict.fromkeys(words), key=lambda w: (-words.count(w), words.index(w)))[:most]


def query_intent(query: str) -> dict:
    low = query.lower()
    service = next((m[0] for p in SERVICE_WORDS if (m := re.search(p, query))), None)
    error = any(w in low for w in ERROR_WORDS)
    kind = next((k for k, words in INTENTS if any(w in low for w in words)), "error_related" if error else "general")
    out = {"keywords": plain_keywords(query), "contains_time_reference": any(re.search(p, query) for p in TIME_WORDS), "contains_service_reference": service is not None, "contains_error_reference": error, "query_type": kind}
    return out | ({"possible_service": service} if service else {})


def expand_query(query: str, intent: dict) -> str:
    more = EXPANSIONS.get(intent["query_type"], [])
    if intent["query_type"] == "error_related" and "error" not in query.lower() and "错误" not in query:
        more = ["error", "exception", "错误", "异常"]
    return f"{query} {' '.join(more)}" if more else query


def context_block(hits: DataFrame, n: int = 5, token_limit: int = 4000) -> DataFrame:
    """One row (context, token_estimate, sources) of the first n hits by rank; beyond the limit of
    tokens the context is cut to six tenths as many characters, with a remark."""
    part = F.concat(
        F.lit("[日志 "), F.col("rank").cast("string"), F.lit("]\n时间: "), F.coalesce(F.col("timestamp").cast("string"), F.lit("")), F.lit("\n级别: "), F.coalesce("log_level", F.lit("")),
        F.lit("\n服务: "), F.coalesce("service_name", F.lit("")), F.lit("\n内容: "), F.coalesce("message", F.lit("")),
        F.when(F.coalesce(F.col("template"), F.lit("")) != "", F.concat(F.lit("\n模板: "), F.col("template"))).otherwise("") if "template" in hits.columns else F.lit(""),
    )
    first = hits.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).where(F.col("rank") <= n)
    source = F.struct("id", F.col("timestamp").cast("string").alias("timestamp"), F.col("service_name").alias("service"), F.col("log_level").alias("level"), F.col("final_score").alias("score"), preview(F.col("message")).alias("message_preview"))
    gathered = first.agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part"), source.alias("source")))).alias("parts"))
    block = gathered.select(F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("context"), F.transform("parts", lambda p: p["source"]).alias("sources"))
    block = block.withColumn("token_estimate", token_estimate(F.col("context")))
    cut = F.concat(F.substring("context", 1, int(token_limit * 0.6)), F.lit(CUT))
    return block.withColumn("context", F.when(F.col("token_estimate") > token_limit, cut).otherwise(F.col("context")))


class Prompts:
    """The prompt template; it must hold both placeholders."""

    def __init__(self, template: str = PROMPT) -> None:
        self.template = template

    def set(self, template: str) -> bool:
        if "{query}" not in template or "{context}" not in template:
            return False
        self.template = template
        return True

    def render(self, query: str, context: str) -> str:
        return self.template.replace("{context}", context).replace("{query}", query)


def classify_prompt(query: str) -> str:
    return f"Classify this log query as one of {', '.join(k for k, _ in INTENTS)}, error_related, general.\nQuery: {query}\nAnswer with the class only."


def time_prompt(query: str, now: str) -> str:
    return f"The time is {now}. Give the time range that this query names as JSON with start and end in ISO-8601, or null.\nQuery: {query}"

"""Registered queries of the log engine and the SQL they are held against.

Each query reads its whole tables. Times are returned as whole numbers from the epoch, so that both
engines give the same values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.checkpoints import shared_folder
from tailrace.functions import text, times
from tailrace.functions.masks import first_in_bucket, with_templates
from tailrace.functions.vectors import neighbours, novelty, top_k
from tailrace.operators import aggregates, anomaly, dedup, drain, models, patterns, prompting, retrieval
from tailrace.operators.similar import similar_texts
from tailrace.plans import pipelines
from tailrace.sources import logs as sources
from tailrace.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: The log rows of FIXTURES.md over events, as SQL.
LOGS = r"""logs AS (SELECT CAST(event_id AS VARCHAR) AS _id, ts, log_level, 'svc-' || (user_id % 8) AS service_name, event_type || '-E' || (k % 7) AS template_key,
  '[' || log_level || '] user=' || user_id || ' code=E' || (k % 7) || ' from 10.0.' || (user_id % 256) || '.' || k || ' took ' || k || 'ms'
  || CASE WHEN log_level = 'ERROR' THEN ' System.TimeoutException: call ' || event_id || ' failed at handler' ELSE '' END AS message
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'INFO' WHEN 'purchase' THEN 'INFO' ELSE 'DEBUG' END AS log_level FROM events))"""
#: Documents as search documents, with vectors where their number has one.
DOCS = "docs AS (SELECT doc_id AS id, text AS message FROM documents)"
QUERY = "ering thing error database"
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql.replace("@LOGS", LOGS).replace("@DOCS", DOCS)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.logs_view(table(spark, sf_dir, "events"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).where("log_level IN ('ERROR', 'FATAL')")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("message"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def seconds(c: str | Column) -> Column:
    return F.floor(F.unix_micros(c) / 1_000_000).cast("long")


def bucket(n: int) -> str:
    return f"CAST(floor(epoch_us(ts) / {n * 1_000_000}e0) AS BIGINT) * {n}"


@query("WITH @LOGS SELECT _id, epoch_us(ts) AS ts_us, log_level, service_name FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND service_name IN ('svc-1', 'svc-2') AND log_level <> 'DEBUG' ORDER BY ts, _id LIMIT 500")
def scan_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.scan(logs(spark, sf_dir), "2024-01-05", "2024-01-12", [{"service_name": ["svc-1", "svc-2"]}, {"log_level": {"$ne": "DEBUG"}}], ["_id", "ts", "log_level", "service_name"], 500)
    return found.select("_id", F.unix_micros("ts").alias("ts_us"), "log_level", "service_name")


@query("WITH @LOGS SELECT epoch_us(max(ts)) AS last_us, count(*) AS n FROM logs")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir)
    return sources.high_water_mark(rows).join(rows.agg(F.count("*").alias("n")), F.lit(True)).select(F.unix_micros("last_ts").alias("last_us"), "n")


@query("WITH @LOGS, u AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY ts DESC, template_key DESC, message DESC, _id DESC, log_level DESC) AS r FROM logs) SELECT service_name, log_level, template_key FROM u WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select("ts", "template_key", "message", "_id", "log_level", "service_name")
    return sources.upsert(None, rows, "service_name").select("service_name", "log_level", "template_key")


@query("WITH @LOGS SELECT service_name, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, service_name LIMIT 100")
def terms_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_terms(logs(spark, sf_dir), "service_name", 100)


@query("WITH @LOGS SELECT log_level, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, log_level LIMIT 20")
def terms_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_terms(logs(spark, sf_dir), "log_level", 20)


@query("WITH @LOGS SELECT count(*) AS total_logs, count(*) FILTER (log_level IN ('ERROR', 'FATAL')) AS error_logs, count(*) FILTER (log_level IN ('ERROR', 'FATAL')) / count(*) AS error_ratio, (SELECT count(*) FROM embeddings) AS vector_count FROM logs")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.stats(logs(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@query("WITH @LOGS SELECT template_key, count(*) AS n, arg_min(message, (ts, _id)) AS example FROM logs WHERE log_level = 'ERROR' GROUP BY 1")
def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.error_patterns(logs(spark, sf_dir), ["template_key"])


@query(f"""WITH @LOGS, c AS (SELECT {bucket(3600)} AS bucket_s, count(*) AS n FROM logs WHERE log_level = 'ERROR' GROUP BY 1),
w AS (SELECT *, greatest(3, count(*) OVER () // 5) AS w, row_number() OVER (ORDER BY bucket_s) AS at, avg(n) OVER () AS am, stddev_samp(n) OVER () AS sd, count(*) OVER () AS size FROM c),
r AS (SELECT a.bucket_s, a.n, CASE WHEN a.at >= a.w THEN (SELECT avg(b.n) FROM w b WHERE b.at > a.at - a.w AND b.at <= a.at) ELSE a.am END AS mean,
  CASE WHEN a.at >= a.w THEN (SELECT stddev_samp(b.n) FROM w b WHERE b.at > a.at - a.w AND b.at <= a.at) ELSE a.sd END AS std FROM w a WHERE a.size >= 10)
SELECT bucket_s, n, round(mean, 6) AS mean, round(std, 6) AS std, round((n - mean) / greatest(std, 1), 6) AS z, abs((n - mean) / greatest(std, 1)) > 2.85 AS anomaly FROM r""")
def error_bucket_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomaly.bucket_zscore(errors(spark, sf_dir))
    return found.select(seconds("bucket").alias("bucket_s"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("z", 6).alias("z"), "anomaly")


@query(f"WITH @LOGS, c AS (SELECT {bucket(86400)} AS bucket_s, log_level FROM logs) SELECT bucket_s, count(*) FILTER (log_level = 'ERROR') AS ERROR, count(*) FILTER (log_level = 'WARN') AS WARN, count(*) FILTER (log_level = 'INFO') AS INFO, count(*) FILTER (log_level = 'DEBUG') AS DEBUG FROM c GROUP BY 1")
def type_bucket_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.pivoted(logs(spark, sf_dir), 86400, "log_level", ["ERROR", "WARN", "INFO", "DEBUG"])
    return found.select(seconds("bucket").alias("bucket_s"), "ERROR", "WARN", "INFO", "DEBUG")


_DAYS = ", ".join(f"count(*) FILTER (d = {i}) AS {n}" for i, n in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"), 1))


@query(f"WITH @LOGS, c AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, isodow(ts) AS d FROM logs) SELECT hour, {_DAYS} FROM c GROUP BY 1")
def hour_weekday_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.hour_by_weekday(logs(spark, sf_dir))


@query("WITH @LOGS, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM logs GROUP BY 1) SELECT day, n, round(avg(n) OVER (), 6) AS mean, round(stddev_samp(n) OVER (), 6) AS std FROM d")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregates.daily(logs(spark, sf_dir))
    return d.select(F.col("day").cast("string").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("WITH @LOGS, c AS (SELECT template_key, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM logs WHERE log_level = 'ERROR' GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY template_key) AS share FROM c) SELECT template_key, hour, n, round(share, 9) AS share FROM s WHERE share >= 0.06 AND n >= 3")
def hour_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.hour_concentration(errors(spark, sf_dir), "template_key", 0.06).withColumn("share", F.round("share", 9))


@query("""WITH @LOGS, c AS (SELECT template_key, count(*) AS n, count(*) FILTER (hour(ts) >= 9 AND hour(ts) < 18 AND isodow(ts) <= 5) / count(*) AS b, count(*) FILTER (isodow(ts) > 5) / count(*) AS w FROM logs WHERE log_level = 'ERROR' GROUP BY 1)
SELECT template_key, n, round(b, 9) AS business_share, round(w, 9) AS weekend_share, round(w * 3.5, 9) AS weekend_factor, CASE WHEN 1 - b >= 0.7 THEN 'non_business' WHEN b >= 0.7 THEN 'business' END AS hours, w * 3.5 >= 1.5 AS weekend FROM c WHERE n >= 3""")
def business_hours_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = patterns.day_parts(errors(spark, sf_dir), "template_key")
    return d.withColumns({c: F.round(c, 9) for c in ("business_share", "weekend_share", "weekend_factor")})


@query("""WITH @LOGS, e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, template_key FROM logs WHERE log_level = 'ERROR'), c AS (SELECT day, template_key, count(*) AS c FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY c DESC, template_key) AS r FROM c), d AS (SELECT day, sum(c) AS n, string_agg(template_key, ',' ORDER BY r) FILTER (r <= 3) AS top FROM r GROUP BY 1),
m AS (SELECT *, avg(n) OVER () AS mean, stddev_samp(n) OVER () AS std, count(*) OVER () AS days FROM d)
SELECT day, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(std, 6) AS std, round((n - mean) / (std + 1), 6) AS confidence, top FROM m WHERE days >= 3 AND n > mean + std""")
def high_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = patterns.high_days(errors(spark, sf_dir), "template_key", 1.0)
    return d.select(F.col("day").cast("string").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("confidence", 6).alias("confidence"), "top")


@query(f"WITH @LOGS, c AS (SELECT {bucket(86400)} AS bucket_s, template_key, count(*) AS n FROM logs GROUP BY 1, 2) SELECT bucket_s, template_key, n, CAST(row_number() OVER (PARTITION BY bucket_s ORDER BY n DESC, template_key) AS INTEGER) AS rank FROM c QUALIFY rank <= 3")
def topn_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_per_bucket(logs(spark, sf_dir), 86400, "template_key").select(seconds("bucket").alias("bucket_s"), "template_key", "n", "rank")


_SESSIONS = "s AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(before) > CAST(@GAP AS BIGINT) * 1000000 THEN 1 ELSE 0 END) OVER (@BY ORDER BY ts, _id) AS session FROM (SELECT *, lag(ts) OVER (@BY ORDER BY ts, _id) AS before FROM logs WHERE log_level = 'ERROR'))"


def sessions_sql(gap: int, by: str = "") -> str:
    return _SESSIONS.replace("@GAP", str(gap)).replace("@BY", f"PARTITION BY {by}" if by else "")


@query(f"WITH @LOGS, {sessions_sql(3600, 'service_name')} SELECT service_name, CAST(session AS BIGINT) AS session, count(*) AS n, epoch_us(min(ts)) AS start_us FROM s GROUP BY 1, 2")
def error_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = patterns.sessions(errors(spark, sf_dir), 3600, ["service_name"])
    return s.groupBy("service_name", "session").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("start_us"))


@query(f"""WITH @LOGS, {sessions_sql(7200, 'service_name')}, o AS (SELECT *, lag(template_key) OVER w AS b FROM s WINDOW w AS (PARTITION BY service_name, session ORDER BY ts, _id)),
k AS (SELECT *, lead(template_key) OVER (PARTITION BY service_name, session ORDER BY ts, _id) AS target FROM o WHERE b IS NULL OR b <> template_key),
n AS (SELECT service_name, template_key, count(*) AS occ FROM k GROUP BY 1, 2), p AS (SELECT service_name, template_key, target, count(*) AS support FROM k WHERE target IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
g AS (SELECT service_name FROM s GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT session) >= 3)
SELECT p.service_name, p.template_key AS source, target, support, round(support / occ, 9) AS confidence FROM p JOIN n USING (service_name, template_key) JOIN g USING (service_name) WHERE support / occ >= 0.05""")
def error_chain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.chains(errors(spark, sf_dir), 7200, 2, 0.05, ["service_name"], None).withColumn("confidence", F.round("confidence", 9))


@query("""WITH @LOGS, e AS (SELECT * FROM logs WHERE log_level = 'ERROR'), n AS (SELECT o.template_key, epoch_us(o.ts) - epoch_us(t.ts) AS d FROM e o JOIN e t ON t.template_key = 'error-E3' AND o.template_key <> 'error-E3' AND abs(epoch_us(o.ts) - epoch_us(t.ts)) <= 3600000000),
c AS (SELECT template_key, count(*) AS n, count(*) FILTER (d < 0) AS before, count(*) FILTER (d > 0) AS after FROM n GROUP BY 1)
SELECT *, CASE WHEN before > 2 * after THEN 'precedes' WHEN after > 2 * before THEN 'follows' ELSE 'co-occurrence' END AS relation FROM c""")
def related_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.related(errors(spark, sf_dir), "error-E3", 3600, "template_key")


@query(f"""WITH @LOGS, c AS (SELECT {bucket(3600)} AS b, service_name, max(CASE WHEN log_level IN ('ERROR', 'FATAL') THEN 1 ELSE 0 END) AS e, min(ts) AS f FROM logs GROUP BY 1, 2), w AS (SELECT b, 1 + max(e) AS w FROM c GROUP BY 1), f AS (SELECT service_name, min(f) AS f FROM c GROUP BY 1),
p AS (SELECT x.service_name AS s1, y.service_name AS s2, CAST(sum(w) AS BIGINT) AS support, count(*) AS buckets FROM c x JOIN c y ON x.b = y.b AND x.service_name < y.service_name JOIN w ON w.b = x.b GROUP BY 1, 2 HAVING sum(w) >= 3)
SELECT CASE WHEN a.f <= z.f THEN s1 ELSE s2 END AS source, CASE WHEN a.f <= z.f THEN s2 ELSE s1 END AS target, support, buckets FROM p JOIN f a ON a.service_name = s1 JOIN f z ON z.service_name = s2""")
def service_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.service_dependencies(logs(spark, sf_dir), 3600, 3, None)


@query("""WITH @LOGS, e AS (SELECT * FROM logs WHERE log_level = 'ERROR'), k AS (SELECT DISTINCT service_name, template_key FROM e WHERE ts < TIMESTAMP '2024-01-03')
SELECT service_name, template_key, epoch_us(min(ts)) AS first_us, count(*) AS n, arg_min(message, (ts, _id)) AS example, 0.7e0 AS severity FROM e ANTI JOIN k USING (service_name, template_key) GROUP BY 1, 2""")
def new_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = errors(spark, sf_dir)
    known = anomaly.known_types(e.where("ts < TIMESTAMP '2024-01-03'"), None, "template_key", ["service_name"])
    found = anomaly.new_error_types(e, known, "template_key", ["service_name"])
    return found.select("service_name", "template_key", F.unix_micros("first_ts").alias("first_us"), "n", "example", "severity")


@query(f"""WITH @LOGS, c AS (SELECT {bucket(21600)} AS bucket_s, template_key, count(*) AS n FROM logs WHERE log_level = 'ERROR' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY bucket_s ORDER BY n DESC, template_key) AS r FROM c),
g AS (SELECT bucket_s, CAST(sum(n) AS BIGINT) AS n_errors, count(*) AS n_types, max(n) FILTER (r <= 3) AS most, min(n) FILTER (r <= 3) AS least, string_agg(template_key, ',' ORDER BY r) FILTER (r <= 3) AS types FROM r GROUP BY 1)
SELECT *, 0.6e0 AS severity FROM g WHERE n_errors >= 3 AND n_types >= 3 AND most / least < 2""")
def error_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomaly.error_combinations(errors(spark, sf_dir), "template_key", 21600)
    return found.select(seconds("bucket").alias("bucket_s"), "n_errors", "n_types", "most", "least", "types", "severity")


@query()
def volume_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomaly.volume_anomalies(errors(spark, sf_dir), "template_key", 21600, 0.95, "service_name")
    return found.select("service_name", seconds("bucket").alias("bucket_s"), "n", F.round("score", 6).alias("score"), "anomaly")


_MASK = r"regexp_replace(regexp_replace(regexp_replace(message, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<IP>', 'g'), '([^A-Za-z0-9])\d+([^A-Za-z0-9]|$)', '\1<NUM>\2', 'g'), '([^A-Za-z0-9])\d+([^A-Za-z0-9]|$)', '\1<NUM>\2', 'g')"


@query(f"WITH @LOGS, m AS (SELECT *, {_MASK} AS template FROM logs), f AS (SELECT template, row_number() OVER (ORDER BY min((ts, _id))) AS template_id FROM m GROUP BY 1) SELECT _id, template, CAST(template_id AS INTEGER) AS template_id FROM m JOIN f USING (template)")
def mask_template_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_templates(logs(spark, sf_dir)).select("_id", "template", "template_id")


@query(f"WITH @LOGS, m AS (SELECT *, {_MASK} AS template, {bucket(1800)} AS b FROM logs) SELECT _id, service_name, message FROM m QUALIFY row_number() OVER (PARTITION BY service_name, b, template ORDER BY ts, _id) = 1")
def prefilter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_in_bucket(logs(spark, sf_dir), 30).select("_id", "service_name", "message")


@query(r"""WITH @LOGS, m AS (SELECT _id, message AS m FROM logs UNION ALL SELECT _id || '-bare', regexp_replace(message, '^\[[A-Z]+\] ', '') FROM logs UNION ALL SELECT 'd' || doc_id, text FROM documents)
SELECT _id, CASE WHEN m = '' THEN '' WHEN regexp_matches(m, '\[(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|ERR|TRACE)\]') THEN regexp_extract(m, '\[(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|ERR|TRACE)\]', 1)
  WHEN contains(lower(m), 'error') OR contains(lower(m), 'exception') THEN 'ERROR' WHEN contains(lower(m), 'warn') THEN 'WARN' WHEN contains(lower(m), 'info') THEN 'INFO' WHEN contains(lower(m), 'debug') THEN 'DEBUG' WHEN contains(lower(m), 'trace') THEN 'TRACE' WHEN contains(lower(m), 'fatal') THEN 'FATAL' ELSE 'INFO' END AS level FROM m""")
def level_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = logs(spark, sf_dir)  # noqa: E741
    rows = l.select("_id", "message").unionAll(l.select(F.concat("_id", F.lit("-bare")), F.regexp_replace("message", r"^\[[A-Z]+\] ", "")))
    rows = rows.unionAll(docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("id").cast("string")), "message"))
    return rows.select("_id", text.level_of(F.col("message")).alias("level"))


@query(r"""WITH p AS (SELECT page_id, coalesce(html, '') || ' ' || url || ' at 2024-01-02T03:04:05Z from 10.1.2.3 id 123e4567-e89b-12d3-a456-426614174000   end' AS t FROM pages), a AS (SELECT page_id, regexp_replace(t, 'https?://(?:[-\p{L}\p{M}\p{Nd}\p{Pc}.]|(?:%[\da-fA-F]{2}))+(?:/[-\p{L}\p{M}\p{Nd}\p{Pc}%!./?=&]*)?', ' [URL] ', 'g') AS t FROM p),
b AS (SELECT page_id, regexp_replace(t, '(?:/[-\p{L}\p{M}\p{Nd}\p{Pc}.]+)+(?:/[-\p{L}\p{M}\p{Nd}\p{Pc}.]+)*', ' [PATH] ', 'g') AS t FROM a), c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b', ' [UUID] ', 'g'), '(?i)\b[0-9a-f]{24}\b', ' [ID] ', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(t, '\b(?:\d{1,3}\.){3}\d{1,3}\b', ' [IP] ', 'g'), '\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[T ]\d{1,2}:\d{1,2}(?::\d{1,2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?', ' [DATE] ', 'g') AS t FROM c)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS cleaned FROM d""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.coalesce("html", F.lit("")), F.lit(" "), "url", F.lit(" at 2024-01-02T03:04:05Z from 10.1.2.3 id 123e4567-e89b-12d3-a456-426614174000   end"))
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(t).alias("cleaned"))


@query(r"""WITH @LOGS SELECT _id, CASE WHEN log_level = 'ERROR' THEN 'TimeoutException=' || regexp_extract(message, 'Exception: (\w+)', 1) || ';' ELSE '' END || 'code=' || regexp_extract(message, 'code=(\w+)', 1) || ';user=' || regexp_extract(message, 'user=(\w+)', 1) AS pairs FROM logs""")
def kv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = F.array_sort(F.map_entries(text.key_values(F.col("message"))))
    return logs(spark, sf_dir).select("_id", F.array_join(F.transform(kv, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("pairs"))


@query(r"""WITH @LOGS, m AS (SELECT _id, nullif(regexp_extract(message, '(System\.[A-Za-z\.]+Exception:.*?)(\s+---|\s+at\s+|$)', 1), '') AS m FROM logs)
SELECT _id, CASE WHEN m IS NOT NULL THEN 'system_exception' END AS exception_type, split_part(m, ':', 1) AS exception_class, m AS exception_message FROM m""")
def exception_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.normalise_exceptions(logs(spark, sf_dir)).select("_id", "exception_type", "exception_class", "exception_message")


@query(r"""WITH @LOGS, m AS (SELECT _id, message AS m, CASE WHEN strpos(message, 'Exception:') > 0 THEN strpos(message, 'Exception:') ELSE 0 END AS pos FROM logs)
SELECT _id, regexp_extract(m, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}', 0) AS extracted_timestamp, CASE WHEN pos > 0 THEN substr(m, pos) ELSE '' END AS stack_trace, trim(CASE WHEN pos > 0 THEN substr(m, 1, pos - 1) ELSE m END) AS cleaned_message FROM m""")
def preprocess_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.preprocess(logs(spark, sf_dir), keep_level=True).select("_id", "extracted_timestamp", "stack_trace", "cleaned_message")


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS["en"])
_PUNCT = text.PUNCTUATION.replace("'", "''")


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(translate(text, '{_PUNCT}', '')), '\\s+'), lambda x: x <> '' AND length(x) >= 2 AND x NOT IN ({_STOP})) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w), c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM c)
SELECT d.doc_id, coalesce((SELECT string_agg(word, ',' ORDER BY r) FROM r WHERE r.doc_id = d.doc_id AND r <= 5), '') AS keywords FROM documents d""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.text_keywords(docs(spark, sf_dir), "id", 5).withColumnRenamed("id", "doc_id")


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, (length(text) + 383) // 384)) AS i FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST((length(text) + 383) // 384 AS INTEGER) AS total_chunks, substr(text, i * 384 + 1, 512) AS chunk FROM c""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("_id"), "message")
    return pipelines.chunked(rows, "message", 512, 128).where("chunk_index is not null").select("doc_id", "chunk_index", "total_chunks", F.col("message").alias("chunk"))


@query("SELECT doc_id, CASE WHEN text = '' THEN '' ELSE md5(text) END AS hash, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def md5_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("id").alias("doc_id"), text.text_hash(F.col("message")).alias("hash"), text.preview(F.col("message")).alias("preview"))


_PENALTY = "CASE WHEN length(@M) = 0 THEN 0.5e0 WHEN n BETWEEN 100 AND 800 THEN 1e0 WHEN n < 100 THEN 0.8e0 + n / 100 * 0.2e0 WHEN n <= 1500 THEN 0.9e0 ELSE greatest(0.6e0, 1e0 - (n - 1500) / 3000) END"
_EFFECTIVE = "(len(regexp_extract_all(@M, '[a-zA-Z]')) + len(regexp_extract_all(@M, '[0-9]')) + 0.5e0 * (length(@M) - len(regexp_extract_all(@M, '[a-zA-Z]')) - len(regexp_extract_all(@M, '[0-9]')) - (length(@M) - length(replace(@M, ' ', '')))))"


@query(f"WITH t AS (SELECT doc_id, text, {_EFFECTIVE.replace('@M', 'text')} AS n FROM documents) SELECT doc_id, round({_PENALTY.replace('@M', 'text')}, 9) AS length_penalty, CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END AS language FROM t")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return docs(spark, sf_dir).select(F.col("id").alias("doc_id"), F.round(text.length_penalty(m), 9).alias("length_penalty"), text.language_of(m).alias("language"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


_COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_FIRST = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings e, {_FIRST} ORDER BY {_COSINE} DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(points(spark, sf_dir), first_vector(spark, sf_dir), 20).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, label, round({_COSINE}, 6) AS score FROM embeddings e, {_FIRST} WHERE label IN (1, 3, 5) AND vec_id >= 10 AND {_COSINE} >= 0.05 ORDER BY {_COSINE} DESC, vec_id LIMIT 20")
def vector_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tailrace.functions.filters import compile_filter

    where = compile_filter({"label": [1, 3, 5], "id": {"$gte": 10}})
    return top_k(points(spark, sf_dir), first_vector(spark, sf_dir), 20, 0.05, where).select("id", "label", F.round("score", 6).alias("score"))


_PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4)"


@query(f"WITH {_PAIRS} SELECT a, b FROM p")
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(points(spark, sf_dir), 0.4)


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), l AS (SELECT n, min(m) AS l FROM r GROUP BY 1), k AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS c FROM (SELECT DISTINCT l FROM l))
SELECT vec_id AS id, CAST(coalesce(c, -1) AS INTEGER) AS dup_cluster_id FROM embeddings LEFT JOIN l ON vec_id = n LEFT JOIN k USING (l)""")
def vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dbscan(points(spark, sf_dir), 0.4)


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), l AS (SELECT n, min(m) AS l FROM r GROUP BY 1),
k AS (SELECT vec_id, l, row_number() OVER (PARTITION BY l ORDER BY vec_id DESC) AS r FROM embeddings LEFT JOIN l ON vec_id = n) SELECT vec_id AS _id FROM k WHERE l IS NULL OR r <= 2""")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.dbscan(points(spark, sf_dir), 0.4).select(F.col("id").alias("_id"), "dup_cluster_id", F.timestamp_seconds("id").alias("ts"))
    return dedup.keep_latest(found, 2).select("_id")


#: One vector of each label, the first; computed over the whole table.
_LABEL_FIRST = "l AS (SELECT label, arg_min(embedding, vec_id) AS embedding, min(vec_id) AS vec_id FROM embeddings GROUP BY 1)"


def label_first(points: DataFrame) -> DataFrame:
    return points.groupBy("label").agg(F.min_by("vector", "id").alias("vector"), F.min("id").alias("id"))


@query(f"""WITH {_LABEL_FIRST}, d AS (SELECT e.vec_id AS id, min(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[]))) AS d FROM embeddings e, l GROUP BY 1)
SELECT id, abs(round(d, 6)) AS distance, d > 0.7 AS novel FROM d""")
def novelty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return novelty(p, label_first(p), 0.7).select("id", F.abs(F.round("distance", 6)).alias("distance"), "novel")


_BM25 = """t AS (SELECT id, regexp_extract_all(lower(message), '[a-z]+') AS t FROM docs), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), u AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM t), f AS (SELECT id, dl, term, count(*) AS tf FROM u WHERE term IN (@TERMS) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))) AS score FROM f JOIN d USING (term), n GROUP BY 1), lex AS (SELECT id, score FROM s ORDER BY round(score, 9) DESC, id LIMIT 50)"""
_TERMS = "'ering', 'thing', 'error', 'database'"


@query(f"WITH @DOCS, {_BM25.replace('@TERMS', _TERMS)} SELECT id, round(score, 6) AS score FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(docs(spark, sf_dir), QUERY.split(), 50).select("id", F.round("score", 6).alias("score"))


_LEXICAL = """t AS (SELECT id, message, regexp_extract_all(lower(message), '[a-z]+') AS t FROM docs WHERE @FILTER), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), u AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM t), f AS (SELECT id, dl, term, count(*) AS tf FROM u WHERE term IN (@TERMS) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))) AS score FROM f JOIN d USING (term), n GROUP BY 1),
lex AS (SELECT id, coalesce(score, 0) AS score FROM t LEFT JOIN s USING (id) WHERE @HIT ORDER BY round(coalesce(score, 0), 9) DESC, id % 1000 DESC, id LIMIT 50)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("timestamp", F.timestamp_seconds(F.col("id") % 1000))


@query("WITH @DOCS, " + _LEXICAL.replace("@FILTER", "id % 3 <> 0").replace("@TERMS", "'the', 'ering', 'thing', 'error', 'database'").replace("@HIT", "len(list_intersect(t, ['ering', 'thing', 'error', 'database'])) >= 1").replace("'the', ", "") + " SELECT id, round(score, 6) AS score FROM lex")
def lexical_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the query under a filter, whose rows alone make the statistics."""
    return retrieval.lexical(dated(spark, sf_dir), QUERY, 50, F.col("id") % 3 != 0).select("id", F.round("score", 6).alias("score"))


@query("WITH @DOCS, " + _LEXICAL.replace("@FILTER", "true").replace("@TERMS", "'thi'").replace("@HIT", "list_contains(t, 'thi') OR (length(message) <= 256 AND contains(message, 'thi'))") + " SELECT id, round(score, 6) AS score FROM lex")
def lexical_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short query is found inside words too, in texts that are kept whole."""
    return retrieval.lexical(dated(spark, sf_dir), "thi").select("id", F.round("score", 6).alias("score"))


_RANKING = ", ".join(f"'{w}'" for w in sorted(prompting.RANKING_STOP_WORDS["en"]))
_TFIDF = f"""x AS (SELECT id, message FROM @HITS UNION ALL SELECT NULL, '{QUERY}'), xt AS (SELECT id, list_concat(list_filter(regexp_extract_all(lower(message), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_RANKING})), regexp_extract_all(message, '[0-9]+')) AS t FROM x), xu AS (SELECT id, unnest(t) AS token FROM xt), xf AS (SELECT id, token, count(*) AS tf FROM xu GROUP BY 1, 2),
xk AS (SELECT token, count(*) AS df FROM xf GROUP BY 1 ORDER BY sum(tf) DESC, token LIMIT 1000), xn AS (SELECT count(*) AS n FROM x), xw AS (SELECT id, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM xf JOIN xk USING (token), xn), xq AS (SELECT token, w AS qw FROM xw WHERE id IS NULL), xv AS (SELECT sqrt(sum(qw * qw)) AS qn FROM xq),
tfidf AS (SELECT id, coalesce(sum(w * coalesce(qw, 0)) / (sqrt(sum(w * w)) * any_value(qn)), 0) AS tfidf FROM xw LEFT JOIN xq USING (token), xv WHERE id IS NOT NULL GROUP BY id)"""


@query(f"WITH @DOCS, {_BM25.replace('@TERMS', _TERMS)}, hits AS (SELECT docs.* FROM docs JOIN lex USING (id)), {_TFIDF.replace('@HITS', 'hits')} SELECT id, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    hits = d.join(retrieval.bm25(d, QUERY.split(), 50).select("id"), "id")
    return retrieval.tfidf_cosine(hits, QUERY).withColumn("tfidf", F.round("tfidf", 6))


_WEIGHTED = (("ering", 1.0), ("thing", 1.0), ("error", 1.0), ("database", 1.0), ("error", 2.5), ("database", 1.5))
_KEYWORD = "(" + " + ".join(f"CASE WHEN contains(message, '{t}') OR contains(lower(message), '{t}') THEN {w}e0 ELSE 0 END" for t, w in _WEIGHTED) + f") / {sum(w for _, w in _WEIGHTED)}e0"


@query(f"WITH @DOCS SELECT id, round({_KEYWORD}, 9) AS keyword_score FROM docs")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.weighted_terms(prompting.query_features(QUERY))
    return docs(spark, sf_dir).select("id", F.round(retrieval.keyword_score(F.col("message"), terms), 9).alias("keyword_score"))


_ENGLISH = f"list_distinct(list_filter(regexp_extract_all(lower(message), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_RANKING})))"
_RELEVANCE = f"CASE WHEN len({_ENGLISH}) = 0 THEN 0e0 ELSE least(1e0, 0.7e0 * len(list_intersect({_ENGLISH}, [{_TERMS}])) / 4 + 0.3e0 * 0.5e0 * len(list_filter([{_TERMS}], lambda q: len(list_filter({_ENGLISH}, lambda w: w <> q AND (contains(w, q) OR contains(q, w)))) > 0)) / 4) END"


@query(f"WITH @DOCS SELECT id, round({_RELEVANCE}, 9) AS english_relevance FROM docs")
def english_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", F.round(retrieval.english_relevance(F.col("message"), QUERY.split()), 9).alias("english_relevance"))


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs over documents and the vectors of the same numbers, merged."""
    d = docs(spark, sf_dir).withColumns({"log_level": F.lit("ERROR"), "service_name": F.concat(F.lit("svc-"), (F.col("id") % 8).cast("string")), "timestamp": F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 100)})
    a = retrieval.bm25(d, QUERY.split(), 50).join(d, "id")
    b = top_k(points(spark, sf_dir), first_vector(spark, sf_dir), 50).select("id", "score").join(d, "id")
    return retrieval.merge(a, b)


_HYBRID = f"""dd AS (SELECT *, 'ERROR' AS log_level, 'svc-' || (id % 8) AS service_name, 1704067200 + id * 100 AS pos FROM docs), {_BM25.replace('@TERMS', _TERMS)}, vec AS (SELECT vec_id AS id, {_COSINE} AS score FROM embeddings e, {_FIRST} ORDER BY score DESC, vec_id LIMIT 50), vd AS (SELECT vec.* FROM vec JOIN docs USING (id)),
h AS (SELECT id, coalesce(lex.score, 0) AS es_score, coalesce(vd.score, 0) AS vector_score FROM lex FULL JOIN vd USING (id)), hits AS (SELECT h.*, message, service_name, pos FROM h JOIN dd USING (id)), {_TFIDF.replace('@HITS', 'hits')},
c AS (SELECT *, lag(pos) OVER w AS a1, lag(service_name) OVER w AS s1, lead(pos) OVER w AS a2, lead(service_name) OVER w AS s2 FROM hits WINDOW w AS (ORDER BY pos, id)),
k AS (SELECT *, CASE WHEN abs(pos - a1) < 300 THEN 1 + (1 - abs(pos - a1) / 300e0) * 0.2e0 ELSE 1 END * CASE WHEN s1 = service_name THEN 1.05e0 ELSE 1 END * CASE WHEN abs(pos - a2) < 300 THEN 1 + (1 - abs(pos - a2) / 300e0) * 0.2e0 ELSE 1 END * CASE WHEN s2 = service_name THEN 1.05e0 ELSE 1 END AS ctx FROM c),
m AS (SELECT *, ctx / greatest(1, max(ctx) OVER ()) AS context_score, {_EFFECTIVE.replace('@M', 'message')} AS n FROM k),
ss AS (SELECT m.id, (0.5e0 * es_score + 0.35e0 * vector_score) AS base, {_RELEVANCE} AS lang, {_KEYWORD} AS kw, coalesce(tfidf, 0) AS tfidf, context_score, {_PENALTY.replace('@M', 'message')} AS pen,
  CASE WHEN length(message) = 0 THEN 0 ELSE least(1e0, least(length(message), {len(QUERY)}) / greatest(length(message), {len(QUERY)}) * 0.2e0 + CASE WHEN regexp_matches(message, '[a-zA-Z]') THEN 1e0 ELSE 0.7e0 END * 0.3e0 + 1.5e0 * 0.3e0) END AS mt,
  CASE WHEN 1706745600 - pos < 3600 THEN 1.2e0 WHEN 1706745600 - pos < 86400 THEN 1.1e0 WHEN 1706745600 - pos < 604800 THEN 1e0 WHEN 1706745600 - pos < 2592000 THEN 0.95e0 ELSE 0.9e0 END AS fresh FROM m LEFT JOIN tfidf USING (id)),
ff AS (SELECT *, (base * 0.3e0 + lang * 0.2e0 + kw * 0.3e0 + mt * 0.1e0 + tfidf * 0.05e0 + (0.9e0 * 0.6e0 + context_score * 0.3e0 + fresh * 0.1e0) * 0.05e0) * pen AS final FROM ss)"""


@query(f"WITH @DOCS, {_HYBRID} SELECT id, CAST(row_number() OVER (ORDER BY round(final, 9) DESC, id) AS INTEGER) AS rank, round(final, 6) AS final_score, round(base, 6) AS base_score, round(context_score, 6) AS context_score FROM ff QUALIFY rank <= 20")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.ranked(hybrid_hits(spark, sf_dir), QUERY, NOW, (0.5, 0.35, 0.15), 20, similarity=F.lit(0.0))
    return found.select("id", "rank", F.round("final_score", 6).alias("final_score"), F.round("base_score", 6).alias("base_score"), F.round("context_score", 6).alias("context_score"))


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).join(points(spark, sf_dir).select("id", "vector"), "id", "left").withColumns({"log_level": F.lit("ERROR"), "service_name": F.lit("svc"), "timestamp": F.timestamp_seconds(F.lit(1704067200) + F.col("id"))})
    found = retrieval.search(d, "the ering thing", first_vector(spark, sf_dir), NOW, least=0.0)["results"]
    return found.select("id", "rank", F.round("final_score", 6).alias("final_score"), "relevance")


@query("""WITH h AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings QUALIFY rank <= 5), p AS (SELECT rank, '[日志 ' || rank || ']' || chr(10) || '时间: ' || vec_id || chr(10) || '级别: L' || label || chr(10) || '服务: s' || chr(10) || '内容: ' || coalesce(text, '') AS p FROM h JOIN documents ON doc_id = vec_id), c AS (SELECT string_agg(p, chr(10) || chr(10) ORDER BY rank) AS c FROM p),
t AS (SELECT c, len(regexp_extract_all(c, '[^ \\n\\t\\r\\f\\v]+')) + 1.5e0 * len(regexp_extract_all(c, '[一-鿿]')) AS token_estimate FROM c)
SELECT CASE WHEN token_estimate > 4000 THEN substr(c, 1, 2400) || '...(内容已截断)' ELSE c END AS context, token_estimate FROM t""")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of whole messages, cut by the limit of tokens alone."""
    e, d = points(spark, sf_dir).orderBy("id").limit(5), docs(spark, sf_dir)
    hits = e.join(d, "id").select("id", F.col("id").alias("rank"), F.col("id").alias("timestamp"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("log_level"), F.lit("s").alias("service_name"), "message", F.lit(0.0).alias("final_score"))
    return prompting.context_block(hits).select("context", "token_estimate")


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, isodow(ts) > 5 AS weekend, hour(ts) >= 9 AND hour(ts) < 18 AND isodow(ts) <= 5 AS business, CASE WHEN epoch(TIMESTAMP '2024-02-01') - epoch(ts) < 86400 THEN 1.1e0 WHEN epoch(TIMESTAMP '2024-02-01') - epoch(ts) < 604800 THEN 1e0 WHEN epoch(TIMESTAMP '2024-02-01') - epoch(ts) < 2592000 THEN 0.95e0 ELSE 0.9e0 END AS freshness FROM events")
def calendar_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in times.calendar(ts).items()), times.freshness(ts, F.lit(NOW).cast("timestamp")).alias("freshness"))


@query(f"WITH {_LABEL_FIRST} SELECT e.vec_id AS id, CAST(arg_min(l.label, (round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])), 9), l.vec_id)) AS BIGINT) AS label FROM embeddings e, l GROUP BY 1")
def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return models.nearest_label(p, label_first(p).orderBy("id"))


@query()
def similar_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_templates(logs(spark, sf_dir)).select(F.col("template_id").alias("id"), F.col("template").alias("text")).distinct()
    return similar_texts(rows, 0.8)[0].withColumn("similarity", F.round("similarity", 9))


@query()
def density_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.cluster_sizes(models.cluster(with_templates(logs(spark, sf_dir)), "template", method="dbscan"))


@query()
def kmeans_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.cluster(with_templates(logs(spark, sf_dir)), "template", 5)
    return aggregates.cluster_sizes(rows)


@query()
def cluster_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.cluster(with_templates(logs(spark, sf_dir)), "template", 4)
    return models.cluster_features(rows).withColumn("weight", F.round("weight", 6))


@query()
def iforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.predict_anomalies(with_templates(logs(spark, sf_dir)))
    return rows.groupBy("template").agg(F.count("*").alias("n"), F.sum("prediction").alias("anomalies"), F.round(F.avg("anomaly_score"), 6).alias("score"))


@query()
def drain_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain.mine(logs(spark, sf_dir)).groupBy("template", "template_id").agg(F.count("*").alias("n"))


@query()
def optimize_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.optimise_k(with_templates(logs(spark, sf_dir)), "template", 2, 4)
    return found.withColumn("silhouette", F.round("silhouette", 6)).withColumn("inertia", F.round("inertia", 4))


def stream_folder(spark: SparkSession) -> str:
    """A new folder under the session's shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return sources.logs_view(jobs.read_stream(spark, f"{sf_dir}/event[s].parquet", schema))


@query("WITH @LOGS SELECT CAST(floor(epoch_us(ts) / 3600000000e0) AS BIGINT) * 3600 AS window_s, log_level, count(*) AS n FROM logs GROUP BY 1, 2")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stream_folder(spark)
    stream = jobs.incremental(event_stream(spark, sf_dir).select("ts", "log_level"), lambda b: b, f"{folder}/rows", f"{folder}/checkpoint")
    stream.awaitTermination()
    return jobs.tumbling(spark.read.parquet(f"{folder}/rows")).select(seconds("window_start").alias("window_s"), "log_level", "n")


@query(f"WITH @LOGS, {sessions_sql(1800, 'service_name')} SELECT service_name, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY service_name, session")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stream_folder(spark)
    jobs.complete(jobs.error_sessions(event_stream(spark, sf_dir), "1800 seconds"), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("service_name", F.unix_micros("start").alias("start_us"), "n")


@query()
def ingest_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipelines.extract_and_process(logs(spark, sf_dir), algorithm="regex")
    return found["error_patterns"].select("template", "template_id", "cluster_id", "n")


@query()
def vector_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipelines.vectorise(first_in_bucket(logs(spark, sf_dir), 60))
    return made.select("id", F.size("vector").alias("dimension"), F.col("metadata")["log_level"].alias("log_level"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

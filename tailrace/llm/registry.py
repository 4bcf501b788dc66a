"""The corpus operators as queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.llm import bpe, chat, knn, licenses, linededup, mixing, quality, simhash, substring, webp
from tailrace.llm.common import table


def op2_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the tokenizer's file is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    members, packs = chat.chat_format(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
    return members.join(chat.read_back(packs), "conversation").drop("conversation")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = webp.from_media(webp.to_media(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_prefix_tree, op2_substring_automata, op3_source_mix, op4_bpe_automaton, op5_simhash_pivots, op6_line_chunks, op7_lossless_webp, op8_voronoi_topk, op9_compression_quality, op10_license_rules)}


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(role || text) + 33 + len(regexp_extract_all(role, p)) + len(regexp_extract_all(text, p)) AS n
      FROM c, (SELECT '[<\[]\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])' AS p))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

OP8_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS i FROM f WHERE first < doc_id),
n AS (SELECT rid, list(i) AS gone, count(*) AS n FROM c GROUP BY rid),
x AS (SELECT d.rid, doc_id, w, n, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS i FROM d LEFT JOIN n ON d.rid = n.rid),
k AS (SELECT x.*, c.i IS NULL AS stays FROM x LEFT JOIN c ON x.rid = c.rid AND x.i = c.i)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, coalesce(any_value(n), 0) AS n_removed,
       sha256(coalesce(string_agg(w[i], ' ' ORDER BY i) FILTER (stays AND i > 0), '')) AS kept_sha256
FROM k GROUP BY rid, doc_id
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w
      FROM d GROUP BY source),
c AS (SELECT *, source_size * 3e0 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             coalesce(sum(source_size * 3e0) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
      FROM t WINDOW o AS (ORDER BY source_size * 3e0 / w, source NULLS LAST)),
v AS (SELECT *, max(CASE WHEN (total - stopped) / remaining * w <= cap THEN (total - stopped) / remaining END) OVER () AS level FROM c),
g AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM v),
b AS (SELECT *, least(CAST(floor(target) AS BIGINT), source_size * 3) AS budget FROM g),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
            + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS k, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, k, len(lines) AS n_lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
e AS (SELECT *, i = n_lines OR ((coalesce(lag(h) OVER w, 0) % 2147483647) * 1000003 + h) % 2147483647 % 4 < 3 AS ends FROM h WINDOW w AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
c AS (SELECT rid, k, c, count(*) AS n, min(i) AS lo, string_agg(line, chr(10) ORDER BY i) AS txt FROM g GROUP BY ALL),
m AS (SELECT rid, k, lo, n + lead(n) OVER w AS n, txt || chr(10) || lead(txt) OVER w AS txt FROM c WINDOW w AS (PARTITION BY rid ORDER BY c)),
u AS (SELECT * FROM (SELECT rid, k, lo, n, txt FROM c UNION ALL SELECT * FROM m) WHERE n >= 2 AND regexp_matches(txt, '[^\x20\x09-\x0D]')),
p AS (SELECT *, min(k) OVER (PARTITION BY txt) AS first, min(lo) OVER (PARTITION BY rid, txt) AS begin FROM u),
x AS (SELECT DISTINCT rid, unnest(range(lo, lo + n)) AS i FROM p WHERE first < k OR lo - begin >= n)
SELECT doc_id, n_lines, count(x.i) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN x ON l.rid = x.rid AND l.i = x.i GROUP BY l.rid, doc_id, n_lines
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_prefix_tree": OP1_SQL, "op2_substring_automata": OP2_SQL, "op8_voronoi_topk": OP8_SQL, "op3_source_mix": OP3_SQL, "op6_line_chunks": OP6_SQL}

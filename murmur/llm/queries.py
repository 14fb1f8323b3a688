"""Registered queries of the corpus operators, with DuckDB SQL where SQL can say them.

Each query applies its operator, with production parameters, to the whole of
its table and names the columns of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import (chat, decontaminate, filter_audit, jaccard_join, langid, line_dedup, lm, mixing, passages, simhash,
                        topk, warc, whitening)
from murmur.llm.common import crc_mod, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.near_duplicate_passages(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("other").alias("other_doc_id"), "first_word", "n_words",
                        "other_first_word", "other_words", "similarity")


@register("op2_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_to_warc(read_table(spark, sf_dir, "pages")).select(
        F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "first_word",
                        "n_words")


OP4_SQL = """
WITH lines AS (
    SELECT doc_id, s.pos, l[s.pos] AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
         LATERAL (SELECT unnest(range(1, len(l) + 1)) AS pos) s
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
    FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


@register("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))
    return lm.score_texts(docs, ~F.col("held_out"), keep=["doc_id", "held_out"], min_count=1)


@register("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"),
                         F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return (langid.identify(docs, model, keep=["doc_id", "held_out"])
            .withColumnRenamed("lang_score", "score"))


OP8_SQL = """
WITH codes AS (
    SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i], 0) > 0) AS bits
    FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
           len(list_filter(range(1, 65), lambda i: q.bits[i] <> c.bits[i]))::INT AS distance
    FROM codes q JOIN codes c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
WHERE rank <= 10
"""


@register("op8_exact_topk", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_vectors(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP9_SQL = """
WITH turns AS (
    SELECT conv_id, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
           replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
    FROM conversations
), speakers AS (
    SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), seen AS (
    SELECT t.conv_id, s.speaker, t.pos // 1000 AS part, t.pos, t.role = s.speaker AS target, t.body,
           '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system'
                                  ELSE 'user name=' || t.role END || chr(10) AS head
    FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
    SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
        PARTITION BY conv_id, speaker, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + length(head) AS start
    FROM seen
)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (target) AS n_target_turns,
       string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(start || '-' || (start + length(body)), ',' ORDER BY pos) FILTER (target), '') AS mask_spans
FROM placed GROUP BY conv_id, speaker, part
"""


@register("op9_chat_formatting", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return chat.rotate_perspectives(read_table(spark, sf_dir, "conversations")).select(
        F.col("conv").alias("conv_id"), "speaker", "part", "n_turns", "n_target_turns", "text",
        spans.alias("mask_spans"))


OP10_SQL = """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
           md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight
    FROM sized GROUP BY source
), filling AS (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))::DOUBLE
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
           (2 * source_size)::DOUBLE / weight AS ratio
    FROM totals
    WINDOW before AS (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
    SELECT arg_min(level, ratio) AS level FROM filling WHERE 2 * source_size > weight * level
), targets AS (
    SELECT source, source_size,
           coalesce(least((2 * source_size)::DOUBLE, weight * (SELECT level FROM final)),
                    (2 * source_size)::DOUBLE) AS target
    FROM totals
), placed AS (
    SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
           coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (budget // greatest(source_size, 1) * size
        + greatest(0, least(size, budget % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM placed
"""


@register("op10_mixing", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


OP11_SQL = """
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), marks AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), fails AS (
    SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
           (len(t.words) < 100)::INT
           + 2 * (100 * len(list_distinct(t.words)) < 80 * len(t.words))::INT
           + 4 * (100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 10 * length(t.text))::INT
           + 8 * regexp_matches(t.text, '[#$%&*|]')::INT
           + 16 * coalesce(t.doc_id > f.first, false)::INT AS mask
    FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, (ascii(filter_order[step]) - 65)::INT AS f,
           coalesce(list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(filter_order[i]) - 65)::INT))), 0)::INT
               AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
    SELECT part, filter_order, step, f,
           coalesce(sum(n) FILTER (mask & before = 0 AND mask >> f & 1 = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & before = 0 AND mask >> f & 1 = 1), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & before <> 0 AND mask >> f & 1 = 1), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = 1 << f), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & before = 0 AND mask >> f & 1 = 1), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (mask & before = 0 AND mask >> f & 1 = 1), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


@register("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        "explained", "identity_error")


@register("op13_ngram_jaccard_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")

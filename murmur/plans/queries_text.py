"""Registered queries: text analysis over the driver's documents, conversations and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from murmur.constants import (CATEGORY_TERMS, KEYWORD_STOP_WORDS, NEGATIVE_TERMS, POSITIVE_TERMS,
                              URGENT_TERMS)
from murmur.functions.text import SQL_PATTERNS, sql_regex
from murmur.operators.text import (analyze_complaints, clean_text, distributions, extract_keywords,
                                   filter_text, lemmatize, preprocess, priority_distribution, sentiment_by_category,
                                   text_summary, vocabulary)
from murmur.plans.catalog import register
from murmur.session import scratch_table_path
from murmur.sources.tables import read_table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_sql(x: str) -> str:
    s = f"lower(coalesce({x}, ''))"
    for p in (SQL_PATTERNS["URL"], SQL_PATTERNS["EMAIL"], SQL_PATTERNS["SPECIAL"]):
        s = f"regexp_replace({s}, {sql_regex(p)}, '', 'g')"
    s = f"regexp_replace({s}, {sql_regex('^' + SQL_PATTERNS['WS'] + '+|' + SQL_PATTERNS['WS'] + '+$')}, '', 'g')"
    return f"regexp_replace({s}, {sql_regex(SQL_PATTERNS['WS'] + '+')}, ' ', 'g')"


def _hits(low: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({low}, {_q(t)}) AS INTEGER)" for t in terms) + ")"


def _analysis_sql(src: str, id_expr: str, text_expr: str) -> str:
    """DuckDB analysis of ``src`` rows; keywords exported as ', '-joined text."""
    cats = list(CATEGORY_TERMS.items())
    score_cols = ", ".join(f"{_hits('low', terms)} AS s{i}" for i, (_, terms) in enumerate(cats))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(cats))) + ")"
    cat_case = ("CASE WHEN t IS NULL OR " + best + " = 0 THEN 'Other' "
                + " ".join(f"WHEN s{i} = {best} THEN {_q(name)}" for i, (name, _) in enumerate(cats)) + " END")
    stops = ", ".join(_q(w) for w in KEYWORD_STOP_WORDS)
    strip = sql_regex("^" + SQL_PATTERNS["WS"] + "+|" + SQL_PATTERNS["WS"] + "+$")
    return f"""
WITH src AS (SELECT {id_expr} AS complaint_id, {text_expr} AS t FROM {src}),
lw AS (SELECT *, lower(t) AS low FROM src),
sc AS (SELECT *, {_hits('low', NEGATIVE_TERMS)} AS neg, {_hits('low', POSITIVE_TERMS)} AS pos,
              {_hits('low', URGENT_TERMS)} AS urg, {score_cols} FROM lw),
base AS (SELECT complaint_id, t AS original_text, {_clean_sql('t')} AS cleaned_text,
                CASE WHEN t IS NULL THEN 'unknown' WHEN neg > pos THEN 'negative' WHEN pos > neg THEN 'positive'
                     ELSE 'neutral' END AS sentiment,
                CASE WHEN t IS NULL THEN 0.0E0 WHEN neg > pos THEN -5.0E-1 WHEN pos > neg THEN 5.0E-1
                     ELSE 0.0E0 END AS sentiment_score,
                {cat_case} AS category, urg
         FROM sc),
pr AS (SELECT *, CASE WHEN original_text IS NULL THEN 'low'
                      WHEN sentiment_score < -6.0E-1 AND urg > 0 THEN 'critical'
                      WHEN urg > 0 OR sentiment_score < -5.0E-1 THEN 'high'
                      WHEN sentiment_score < -2.0E-1 THEN 'medium' ELSE 'low' END AS priority
       FROM base),
cl AS (SELECT complaint_id,
              regexp_replace(regexp_replace(lower(t), {sql_regex(SQL_PATTERNS['NON_WORD'])}, '', 'g'), {strip}, '', 'g') AS x
       FROM src WHERE t IS NOT NULL),
sp AS (SELECT complaint_id, CASE WHEN x = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(x, {sql_regex(SQL_PATTERNS['WS'] + '+')})
                            END AS ws FROM cl),
tok AS (SELECT complaint_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM sp),
fr AS (SELECT complaint_id, word, count(*) AS freq, min(pos) AS first_pos FROM tok
       WHERE length(word) >= 4 AND word NOT IN ({stops}) GROUP BY complaint_id, word),
rk AS (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY freq DESC, first_pos) AS rank FROM fr),
kw AS (SELECT complaint_id, string_agg(word, ', ' ORDER BY rank) AS keywords FROM rk WHERE rank <= 5
       GROUP BY complaint_id),
an AS (SELECT pr.complaint_id, original_text, cleaned_text, sentiment, sentiment_score, category, priority,
              coalesce(kw.keywords, '') AS keywords
       FROM pr LEFT JOIN kw ON pr.complaint_id = kw.complaint_id)
"""


def _export(df):
    return df.withColumn("keywords", F.array_join("keywords", ", "))


def _documents(spark, sf_dir, with_keywords=True):
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("complaint_id"),
                                                      F.col("text").alias("complaint_text"))
    return analyze_complaints(d, with_keywords=with_keywords)


def _conversations(spark, sf_dir, with_keywords=True):
    c = read_table(spark, sf_dir, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("complaint_id"),
        F.col("text").alias("complaint_text"))
    return analyze_complaints(c, with_keywords=with_keywords)


_DOC_SQL = _analysis_sql("documents", "doc_id", "text")
_CONV_SQL = _analysis_sql("conversations", "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)", "text")


@register("analyze_documents", _DOC_SQL + "SELECT * FROM an")
def q_analyze_documents(spark, sf_dir):
    return _export(_documents(spark, sf_dir))


@register("analyze_conversations", _CONV_SQL + "SELECT * FROM an")
def q_analyze_conversations(spark, sf_dir):
    return _export(_conversations(spark, sf_dir))


@register("document_keywords", _DOC_SQL + """
SELECT complaint_id AS doc_id, word, freq, first_pos, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5""")
def q_document_keywords(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return extract_keywords(d, "doc_id", "text").select(
        "doc_id", "word", "freq", F.col("first_pos").cast("bigint").alias("first_pos"), "rank")


@register("text_distributions", _DOC_SQL + """
SELECT 'sentiment' AS field, sentiment AS value, count(*) AS count FROM an GROUP BY sentiment
UNION ALL SELECT 'category', category, count(*) FROM an GROUP BY category
UNION ALL SELECT 'priority', priority, count(*) FROM an GROUP BY priority""")
def q_text_distributions(spark, sf_dir):
    return distributions(_documents(spark, sf_dir, with_keywords=False))


@register("text_summary", _DOC_SQL + """
SELECT count(*) AS total, avg(sentiment_score) AS mean_sentiment_score,
       count(CASE WHEN sentiment = 'negative' THEN 1 END) * 1.0E2 / count(*) AS pct_negative,
       count(CASE WHEN priority IN ('high', 'critical') THEN 1 END) AS high_priority,
       count(DISTINCT category) AS categories FROM an""")
def q_text_summary(spark, sf_dir):
    return text_summary(_documents(spark, sf_dir, with_keywords=False))


@register("sentiment_by_category", _DOC_SQL + """
SELECT category, count(CASE WHEN sentiment = 'negative' THEN 1 END) AS negative,
       count(CASE WHEN sentiment = 'neutral' THEN 1 END) AS neutral,
       count(CASE WHEN sentiment = 'positive' THEN 1 END) AS positive,
       count(CASE WHEN sentiment = 'unknown' THEN 1 END) AS unknown
FROM an GROUP BY category""")
def q_sentiment_by_category(spark, sf_dir):
    return sentiment_by_category(_documents(spark, sf_dir, with_keywords=False))


@register("clean_pages", f"""
SELECT page_id, {_clean_sql("url || ' ' || html")} AS cleaned_text FROM pages""")
def q_clean_pages(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", clean_text(F.concat("url", F.lit(" "), "html")).alias("cleaned_text"))


@register("overview_kpis", _DOC_SQL + """
SELECT count(*) AS total, count(CASE WHEN sentiment = 'negative' THEN 1 END) * 1.0E2 / count(*) AS pct_negative,
       count(CASE WHEN priority IN ('high', 'critical') THEN 1 END) AS high_priority,
       count(DISTINCT category) AS categories FROM an""")
def q_overview_kpis(spark, sf_dir):
    from murmur.operators.text import overview_kpis
    return overview_kpis(_documents(spark, sf_dir, with_keywords=False))


@register("category_distribution", _CONV_SQL + """
SELECT category, count(*) AS count FROM an GROUP BY category ORDER BY count DESC, category LIMIT 10""")
def q_category_distribution(spark, sf_dir):
    from murmur.operators.text import value_distribution
    return value_distribution(_conversations(spark, sf_dir, with_keywords=False), "category", top=10)


@register("priority_distribution", _DOC_SQL + """
SELECT CAST(i - 1 AS INTEGER) AS priority_rank, p AS priority, count(an.priority) AS count
FROM (SELECT unnest(['low', 'medium', 'high', 'critical']) AS p, unnest([1, 2, 3, 4]) AS i) l
LEFT JOIN an ON an.priority = l.p GROUP BY i, p""")
def q_priority_distribution(spark, sf_dir):
    return priority_distribution(_documents(spark, sf_dir, with_keywords=False))


@register("filter_text", _DOC_SQL + """
SELECT complaint_id, sentiment, category, priority FROM an
WHERE sentiment IN ('negative', 'positive') AND category IN ('Other', 'Billing/Payment')""")
def q_filter_text(spark, sf_dir):
    found = filter_text(_documents(spark, sf_dir, with_keywords=False), ["negative", "positive"],
                        ["Other", "Billing/Payment"])
    return found.select("complaint_id", "sentiment", "category", "priority")


_PHRASES = [
    "The charger was broken and faulty, stopped working",
    "Rude and unhelpful staff, the worst support",
    "Delivery delayed, the package arrived late",
    "I was overcharged, wrong amount on the invoice",
    "The app shows an error and the website is not loading, urgent",
    "Please refund and replace it, money back",
    "Locked out of my account, password and login fail, urgent",
    "Great service, I love it, excellent",
    "Nothing to report",
    "Terrible and dangerous, my lawyer will call immediately",
    "",
    "Broken on arrival and a rude employee",
]


@register("phrase_categories", _analysis_sql(
    "(SELECT event_id, list_extract([" + ", ".join(_q(p) for p in _PHRASES)
    + "], CAST(event_id % 12 AS INTEGER) + 1) AS text FROM events)", "event_id", "text") + """
SELECT complaint_id AS event_id, sentiment, category, priority FROM an""")
def q_phrase_categories(spark, sf_dir):
    """Events with a phrase each: texts that reach every category and term list."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("event_id") % 12 + 1).cast("int"))
    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("complaint_id"),
                                                      phrase.alias("complaint_text"))
    return analyze_complaints(rows, with_keywords=False).select(
        F.col("complaint_id").alias("event_id"), "sentiment", "category", "priority")


@register("preprocess_documents", f"""
WITH c AS (SELECT doc_id, {_clean_sql('text')} AS x FROM documents),
tok AS (SELECT doc_id, unnest(string_split(x, ' ')) AS word, unnest(range(0, len(string_split(x, ' ')))) AS pos FROM c),
kept AS (SELECT * FROM tok WHERE word <> '' AND lower(word) NOT IN ({", ".join(_q(w) for w in KEYWORD_STOP_WORDS)})),
voc AS (SELECT DISTINCT word FROM kept),
lem AS (SELECT f.word AS form, b.word AS lemma FROM voc f JOIN voc b ON f.word = b.word || 's'),
res AS (SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY pos) AS t
        FROM kept LEFT JOIN lem ON form = word GROUP BY doc_id)
SELECT c.doc_id, coalesce(res.t, '') AS cleaned_text FROM c LEFT JOIN res ON res.doc_id = c.doc_id""")
def q_preprocess_documents(spark, sf_dir):
    """The cleaning chain; lemmas are the words of which the texts hold a form with an s."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # written once: the vocabulary, the forms and the texts to rebuild all read the cleaned texts
    path = scratch_table_path(spark, f"cleaned-{uuid.uuid4().hex}")
    preprocess(docs, "text").select("doc_id", "cleaned_text").write.parquet(path)
    cleaned = spark.read.parquet(path)
    voc = vocabulary(cleaned, "cleaned_text")
    lemmas = voc.select(F.concat("word", F.lit("s")).alias("form"), F.col("word").alias("lemma"))
    return lemmatize(cleaned, "cleaned_text", "doc_id", lemmas)

"""Registered queries: tables and reports over anomalies, insights, surges, repeaters, validation and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.constants import NEGATIVE_TERMS, NO_KEYWORDS, POSITIVE_TERMS, SLAB_ORDER
from murmur.operators.anomalies import anomalies_from_counts
from murmur.operators.counts import daily_counts
from murmur.operators.dashboard import anomaly_table
from murmur.operators.enrich import filter_insights, narrate, persistent_anomalies
from murmur.operators.repeats import repeat_complainers, repeat_summaries, top_breakdowns
from murmur.operators.resolution import aging, slab_rank
from murmur.operators.surges import level_counts, surge_table, surges_from_levels
from murmur.operators.text import format_report, lexicon_polarity
from murmur.operators.validate import date_list, validation_result
from murmur.plans.catalog import register
from murmur.plans.oracle import with_complaints
from murmur.plans.queries_core import ANOMALY_CTES
from murmur.plans.queries_ops import _aging_sql, _summary_sql
from murmur.plans.queries_periods import _surge_sql
from murmur.plans.queries_text import _DOC_SQL, _documents
from murmur.plans.queries_views import _GAPS_CTE
from murmur.sources.tables import complaints, read_table

EV, ORD = "complaints_ev", "complaints_ord"


def _anomalies(spark, sf_dir):
    return anomalies_from_counts(daily_counts(complaints(spark, sf_dir, EV)))


@register("persistent_anomalies", with_complaints(EV, *ANOMALY_CTES) + """
SELECT * FROM an WHERE EXISTS (SELECT 1 FROM an p WHERE p.anomaly_date = an.anomaly_date - 1
                               AND p.dimension = an.dimension AND p.dimension_key = an.dimension_key)""")
def q_persistent_anomalies(spark, sf_dir):
    return persistent_anomalies(_anomalies(spark, sf_dir))


@register("anomaly_table", with_complaints(EV, *ANOMALY_CTES) + """
SELECT an.*, row_number() OVER (PARTITION BY anomaly_date ORDER BY z_score DESC, dimension, dimension_key) = 1 AS strongest FROM an""")
def q_anomaly_table(spark, sf_dir):
    """All anomalies, the strongest of each date marked."""
    table = anomaly_table(_anomalies(spark, sf_dir))
    best = table.groupBy("anomaly_date").agg(
        F.min(F.struct(-F.col("z_score"), "dimension", "dimension_key")).alias("_best"))
    return table.join(best, "anomaly_date").select(*table.columns, (
        (F.col("dimension") == F.col("_best.dimension")) & (F.col("dimension_key") == F.col("_best.dimension_key"))).alias("strongest"))


@register("filter_insights", with_complaints(EV, *ANOMALY_CTES) + """
SELECT CAST(anomaly_date AS TIMESTAMP) AS created_at, 'Spike in ' || dimension_key || ' (' || dimension || ')' AS title, severity, z_score
FROM an WHERE severity <> 'INFO' AND anomaly_date >= (SELECT max(sr_open_dt) - 6 FROM c)""")
def q_filter_insights(spark, sf_dir):
    """The insights of the last seven dates."""
    last = complaints(spark, sf_dir, EV).agg(F.max("sr_open_dt")).scalar()
    return filter_insights(narrate(_anomalies(spark, sf_dir)), F.date_sub(last, 6)).select("created_at", "title", "severity", "z_score")


@register("surge_table", _surge_sql(EV))
def q_surge_table(spark, sf_dir):
    return surge_table(surges_from_levels(level_counts(complaints(spark, sf_dir, EV))))


@register("repeat_top_breakdowns", """
SELECT breakdown, region, exc_id, city, sr_sub_type, severity, repeater_count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY breakdown ORDER BY repeater_count DESC, region NULLS FIRST, exc_id NULLS FIRST,
                               city NULLS FIRST, sr_sub_type NULLS FIRST, severity NULLS FIRST) AS rank FROM (
""" + _summary_sql() + """) s) WHERE breakdown IN ('exchange', 'city', 'subtype') AND rank <= 10
   OR breakdown IN ('region_subtype', 'exchange_subtype', 'city_subtype') AND rank <= 20""")
def q_repeat_top_breakdowns(spark, sf_dir):
    return top_breakdowns(repeat_summaries(repeat_complainers(complaints(spark, sf_dir, EV))))


@register("aging_slab_order", "SELECT date, dimension, dimension_key, slab, count, CAST(list_position(["
          + ", ".join(f"'{s}'" for s in SLAB_ORDER) + "], slab) - 1 AS INTEGER) AS slab_rank FROM (" + _aging_sql(ORD)
          + ") x WHERE date = (SELECT max(date) FROM (" + with_complaints(ORD) + "SELECT max(sr_open_dt) AS date FROM c) m)")
def q_aging_slab_order(spark, sf_dir):
    c = complaints(spark, sf_dir, ORD)
    return aging(c, c.agg(F.max("sr_open_dt")).scalar()).withColumn("slab_rank", slab_rank(F.col("slab")))


@register("daily_counts_two_dimensions", with_complaints(EV) + """
SELECT 'Region' AS dimension, region AS dimension_key, sr_open_dt AS day, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT 'City', city, sr_open_dt, count(*) FROM c GROUP BY ALL""")
def q_daily_counts_two_dimensions(spark, sf_dir):
    return daily_counts(complaints(spark, sf_dir, EV), ["City", "Region"])


# -- validation -------------------------------------------------------------------
@register("validation_result_orders", with_complaints(ORD, _GAPS_CTE, """
i AS (SELECT printf('Found %d rows with missing %s', null_count, column_name) AS issue
      FROM (SELECT 'region' AS column_name, count(*) FILTER (WHERE region IS NULL) AS null_count FROM c
            UNION ALL SELECT 'sr_type', count(*) FILTER (WHERE sr_type IS NULL) FROM c
            UNION ALL SELECT 'rca', count(*) FILTER (WHERE rca IS NULL) FROM c) WHERE null_count > 0
      UNION ALL
      SELECT printf('Missing data for %d hours: %s...', count(*),
                    array_to_string(list_slice(list_sort(list(strftime(hour, '%Y-%m-%d %H:00:00'))), 1, 5), ', '))
      FROM gaps HAVING count(*) > 0)""") + """
SELECT 'success' AS status, (SELECT count(*) FROM c) AS row_count, count(*) AS issues_found,
       coalesce(string_agg(issue, ' / ' ORDER BY issue), '') AS issues FROM i""")
def q_validation_result_orders(spark, sf_dir):
    return validation_result(complaints(spark, sf_dir, ORD)).withColumn("issues", F.array_join("issues", " / "))


@register("date_list_orders", with_complaints(ORD) + "SELECT sr_open_dt AS date, count(*) AS rows FROM c GROUP BY sr_open_dt")
def q_date_list_orders(spark, sf_dir):
    return date_list(complaints(spark, sf_dir, ORD))


# -- texts ------------------------------------------------------------------------
@register("format_report", _DOC_SQL + f"""
SELECT complaint_id, 'Complaint: ' || coalesce(original_text, '') || chr(10) || 'Sentiment: ' || upper(sentiment) || chr(10)
       || 'Sentiment Score: ' || printf('%.3f', sentiment_score) || chr(10) || 'Category: ' || category || chr(10)
       || 'Priority Level: ' || upper(priority) || chr(10) || 'Key Topics: '
       || CASE WHEN keywords = '' THEN '{NO_KEYWORDS}' ELSE keywords END AS report FROM an""")
def q_format_report(spark, sf_dir):
    return format_report(_documents(spark, sf_dir))


_WEIGHTS = {**{w: -1.0 for w in NEGATIVE_TERMS if " " not in w}, **{w: 0.5 for w in POSITIVE_TERMS if " " not in w}}


@register("lexicon_polarity", _DOC_SQL + """
, lex(term, weight) AS (VALUES """ + ", ".join(f"('{w}', CAST({x:.1f} AS DOUBLE))" for w, x in _WEIGHTS.items()) + """),
ps AS (SELECT complaint_id, floor(avg(weight) * 1000 + 0.5) / 1000 AS p
       FROM (SELECT complaint_id, unnest(ws) AS term FROM sp) t JOIN lex USING (term) GROUP BY complaint_id),
pl AS (SELECT d.doc_id, coalesce(ps.p, 0.0E0) AS polarity FROM documents d LEFT JOIN ps ON ps.complaint_id = d.doc_id)
SELECT doc_id, polarity, CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment
FROM pl""")
def q_lexicon_polarity(spark, sf_dir):
    lexicon = spark.createDataFrame(list(_WEIGHTS.items()), "term string, weight double")
    return lexicon_polarity(read_table(spark, sf_dir, "documents"), "doc_id", "text", lexicon)

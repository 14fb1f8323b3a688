"""Registered queries: anomaly enrichment (correlation, root cause, severity, narrative)."""

from __future__ import annotations

from murmur.operators.anomalies import anomalies_from_counts
from murmur.operators.counts import daily_counts
from murmur.operators.enrich import (anomaly_correlations, daily_rca_counts, enrich_anomalies, narrate,
                                     top_root_causes)
from murmur.plans.catalog import register
from murmur.plans.oracle import with_complaints
from murmur.plans.queries_core import ANOMALY_CTES
from murmur.sources.tables import complaints

EV = "complaints_ev"


def _base(spark, sf_dir):
    c = complaints(spark, sf_dir, EV)
    counts = daily_counts(c)
    return c, counts, anomalies_from_counts(counts)


_CORR_CTES = ("""
ad AS (SELECT DISTINCT anomaly_date AS t FROM an)""", """
tot AS (SELECT ad.t, dc.dimension, dc.dimension_key, sum(dc.n) AS rows
        FROM ad JOIN dc ON dc.day BETWEEN ad.t - 30 AND ad.t
        WHERE dc.dimension IN ('Type', 'Region') GROUP BY ad.t, dc.dimension, dc.dimension_key)""", """
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, dimension
                                                  ORDER BY rows DESC, dimension_key ASC NULLS FIRST) AS rank
                      FROM tot)
       WHERE rank <= 5 AND dimension_key IS NOT NULL)""", """
pr AS (SELECT an.anomaly_date, an.dimension, an.dimension_key, tk.dimension AS target_dimension,
              tk.dimension_key AS target_key, CAST(tk.rank AS INTEGER) AS target_rank
       FROM an JOIN tk ON tk.t = an.anomaly_date AND tk.dimension <> an.dimension)""", """
ser AS (SELECT pr.*, CAST(x.n AS DOUBLE) AS n1, CAST(y.n AS DOUBLE) AS n2
        FROM pr JOIN dc x ON x.dimension = pr.dimension AND x.dimension_key = pr.dimension_key
                         AND x.day BETWEEN pr.anomaly_date - 30 AND pr.anomaly_date
                JOIN dc y ON y.dimension = pr.target_dimension AND y.dimension_key = pr.target_key
                         AND y.day = x.day)""", """
cg AS (SELECT anomaly_date, dimension, dimension_key, target_dimension, target_key, target_rank,
              count(*) AS common_days, sum(n1) AS sx, sum(n2) AS sy, sum(n1 * n1) AS sxx, sum(n2 * n2) AS syy,
              sum(n1 * n2) AS sxy
       FROM ser GROUP BY anomaly_date, dimension, dimension_key, target_dimension, target_key, target_rank
       HAVING count(*) >= 3)""", """
cr AS (SELECT anomaly_date, dimension, dimension_key, target_dimension, target_key, target_rank,
              CASE WHEN common_days * sxx - sx * sx > 0 AND common_days * syy - sy * sy > 0
                   THEN (common_days * sxy - sx * sy)
                        / sqrt((common_days * sxx - sx * sx) * (common_days * syy - sy * sy)) END AS r,
              common_days
       FROM cg)""", """
corr AS (SELECT * FROM cr WHERE r > 7.0E-1)""")

_RCA_CTES = ("""
rcc AS (SELECT day, dimension, dimension_key, rca, count(*) AS n FROM (
          SELECT sr_open_dt AS day, 'Type' AS dimension, sr_type AS dimension_key, rca FROM c
          UNION ALL SELECT sr_open_dt, 'Region', region, rca FROM c
          UNION ALL SELECT sr_open_dt, 'Exchange', exc_id, rca FROM c)
        GROUP BY day, dimension, dimension_key, rca)""", """
rx AS (SELECT r.*, sum(n) OVER (PARTITION BY day, dimension, dimension_key) AS total,
              row_number() OVER (PARTITION BY day, dimension, dimension_key ORDER BY n DESC, rca ASC NULLS FIRST)
                AS rank
       FROM rcc r
       WHERE EXISTS (SELECT 1 FROM an WHERE an.anomaly_date = r.day AND an.dimension = r.dimension
                                         AND an.dimension_key = r.dimension_key))""", """
roots AS (SELECT day AS anomaly_date, dimension, dimension_key, rca, n, n / total * 1.0E2 AS share_pct,
                 CAST(rank AS INTEGER) AS rank
          FROM rx WHERE rank <= 3)""")

_ENRICH_CTES = ("""
ctxc AS (SELECT anomaly_date, dimension, dimension_key,
                'Correlated with: ' || string_agg(target_key || ' (' || printf('%.2f', floor(r * 1.0E2 + 5.0E-1) / 1.0E2)
                                                  || ')', ', '
                                                  ORDER BY CASE target_dimension WHEN 'Type' THEN 0 ELSE 1 END,
                                                           target_rank) AS correlation_text
         FROM corr GROUP BY anomaly_date, dimension, dimension_key)""", """
ctxr AS (SELECT anomaly_date, dimension, dimension_key,
                'Probable RCA: ' || string_agg(coalesce(rca, 'None') || ' ('
                                               || printf('%.1f', floor(share_pct * 1.0E1 + 5.0E-1) / 1.0E1) || '%)',
                                               ', ' ORDER BY rank) AS rca_text
         FROM roots GROUP BY anomaly_date, dimension, dimension_key)""", """
ea AS (SELECT an.anomaly_date, an.dimension, an.dimension_key, an.metric_value, an.baseline_avg, an.baseline_std,
              an.z_score, an.severity, concat_ws(' | ', ctxc.correlation_text, ctxr.rca_text) AS rca_context
       FROM an LEFT JOIN ctxc USING (anomaly_date, dimension, dimension_key)
               LEFT JOIN ctxr USING (anomaly_date, dimension, dimension_key))""", """
enr AS (SELECT a.anomaly_date, a.dimension, a.dimension_key, a.metric_value, a.baseline_avg, a.baseline_std,
               a.z_score,
               CASE WHEN a.severity = 'WARNING' AND (
                      EXISTS (SELECT 1 FROM an p WHERE p.anomaly_date = a.anomaly_date - 1
                                AND p.dimension = a.dimension AND p.dimension_key = a.dimension_key)
                      OR (a.dimension = 'Type' AND (SELECT count(*) FROM an q WHERE q.anomaly_date = a.anomaly_date
                                                      AND q.dimension = 'Region') > 3))
                    THEN 'CRITICAL' ELSE a.severity END AS severity,
               a.rca_context
        FROM ea a)""")


@register("anomaly_correlations", with_complaints(EV, *ANOMALY_CTES, *_CORR_CTES) + "SELECT * FROM corr")
def q_anomaly_correlations(spark, sf_dir):
    _, counts, an = _base(spark, sf_dir)
    return anomaly_correlations(an, counts)


@register("top_root_causes", with_complaints(EV, *ANOMALY_CTES, *_RCA_CTES) + "SELECT * FROM roots")
def q_top_root_causes(spark, sf_dir):
    c, _, an = _base(spark, sf_dir)
    return top_root_causes(an, daily_rca_counts(c))


@register("enriched_anomalies",
          with_complaints(EV, *ANOMALY_CTES, *_CORR_CTES, *_RCA_CTES, *_ENRICH_CTES) + "SELECT * FROM enr")
def q_enriched_anomalies(spark, sf_dir):
    c, counts, an = _base(spark, sf_dir)
    return enrich_anomalies(an, counts, daily_rca_counts(c))


@register("exec_insights", with_complaints(EV, *ANOMALY_CTES, *_CORR_CTES, *_RCA_CTES, *_ENRICH_CTES) + """
SELECT CAST(anomaly_date AS TIMESTAMP) AS created_at,
       'Spike in ' || dimension_key || ' (' || dimension || ')' AS title,
       'On ' || strftime(anomaly_date, '%Y-%m-%d') || ', detected ' || CAST(CAST(metric_value AS BIGINT) AS VARCHAR)
       || ' complaints (Baseline: ' || printf('%.1f', floor(baseline_avg * 1.0E1 + 5.0E-1) / 1.0E1)
       || '). Deviation: ' || printf('%.1f', floor(z_score * 1.0E1 + 5.0E-1) / 1.0E1) || 'σ. Severity: '
       || severity || '. ' || CASE WHEN coalesce(rca_context, '') <> '' THEN chr(10) || 'Context: ' || rca_context
                                   ELSE '' END AS summary,
       severity, z_score
FROM enr WHERE severity <> 'INFO'""")
def q_exec_insights(spark, sf_dir):
    c, counts, an = _base(spark, sf_dir)
    return narrate(enrich_anomalies(an, counts, daily_rca_counts(c)))


@register("correlation_top_keys", with_complaints(EV, *ANOMALY_CTES, _CORR_CTES[0], _CORR_CTES[1]) + """
SELECT t, dimension, dimension_key, CAST(rows AS BIGINT) AS rows, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY t, dimension ORDER BY rows DESC, dimension_key ASC NULLS FIRST) AS rank
  FROM tot) WHERE rank <= 5""")
def q_correlation_top_keys(spark, sf_dir):
    """Top 5 types and regions by rows in [t - 30, t] for every anomaly date t."""
    from murmur.operators.enrich import top_keys
    _, counts, an = _base(spark, sf_dir)
    return top_keys(counts, an.select(an.anomaly_date.alias("t")))

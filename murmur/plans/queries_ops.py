"""Registered queries: repeat complainers, resolution time and ageing."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators.repeats import repeat_complainers, repeat_kpis, repeat_summaries, top_repeaters
from murmur.operators.resolution import aging, aging_backfill, mttr, mttr_breakdown, mttr_trend
from murmur.plans.catalog import register
from murmur.plans.oracle import with_complaints
from murmur.sources.tables import complaints

EV = "complaints_ev"
ORD = "complaints_ord"

_REPEATERS_CTES = ("""
t AS (SELECT max(sr_open_dt) AS t FROM c)""", """
r AS (SELECT c.* FROM c JOIN t ON c.sr_open_dt BETWEEN t.t - 30 AND t.t
      WHERE c.mdn IS NOT NULL AND c.mdn <> '')""", """
cnt AS (SELECT mdn, count(*) AS repeat_count FROM r GROUP BY mdn HAVING count(*) > 1)""", """
rep AS (SELECT mdn, region, exc_id, city FROM
          (SELECT *, row_number() OVER (PARTITION BY mdn ORDER BY sr_open_dttm, sr_number) AS rn FROM r)
        WHERE rn = 1)""", """
st AS (SELECT mdn, sr_sub_type FROM
         (SELECT mdn, sr_sub_type,
                 row_number() OVER (PARTITION BY mdn ORDER BY count(*) DESC, sr_sub_type) AS rn
          FROM r WHERE sr_sub_type IS NOT NULL GROUP BY mdn, sr_sub_type)
       WHERE rn = 1)""", """
rp AS (SELECT t.t AS target_date, cnt.mdn, cnt.repeat_count, rep.region, rep.exc_id, rep.city, st.sr_sub_type,
              CASE WHEN cnt.repeat_count > 10 THEN 'VERY ALARMING' WHEN cnt.repeat_count > 6 THEN 'CRITICAL'
                   WHEN cnt.repeat_count > 3 THEN 'ALARMING' ELSE 'NORMAL REPEAT' END AS severity
       FROM cnt JOIN rep ON cnt.mdn = rep.mdn LEFT JOIN st ON cnt.mdn = st.mdn CROSS JOIN t)""")


def _repeaters(view=EV, *more):
    return with_complaints(view, *_REPEATERS_CTES, *more)


@register("repeat_complainers", _repeaters() + "SELECT * FROM rp")
def q_repeat_complainers(spark, sf_dir):
    return repeat_complainers(complaints(spark, sf_dir, EV))


_SUMMARY_PARTS = [
    ("region", ["region"]), ("region_subtype", ["region", "sr_sub_type"]), ("exchange", ["exc_id"]),
    ("exchange_subtype", ["exc_id", "sr_sub_type"]), ("city", ["city"]), ("city_subtype", ["city", "sr_sub_type"]),
    ("severity", ["severity"]), ("subtype", ["sr_sub_type"]),
]


def _summary_sql() -> str:
    cols = ["region", "exc_id", "city", "sr_sub_type", "severity"]
    parts = []
    for name, keys in _SUMMARY_PARTS:
        sel = ", ".join(c if c in keys else f"CAST(NULL AS VARCHAR) AS {c}" for c in cols)
        parts.append(f"SELECT '{name}' AS breakdown, {sel}, count(*) AS repeater_count FROM rp "
                     f"GROUP BY {', '.join(keys)}")
    return _repeaters() + "\nUNION ALL ".join(parts)


@register("repeat_summaries", _summary_sql())
def q_repeat_summaries(spark, sf_dir):
    return repeat_summaries(repeat_complainers(complaints(spark, sf_dir, EV)))


@register("top_repeaters", _repeaters() + "SELECT * FROM rp ORDER BY repeat_count DESC, mdn LIMIT 100")
def q_top_repeaters(spark, sf_dir):
    return top_repeaters(repeat_complainers(complaints(spark, sf_dir, EV)))


@register("repeat_kpis", _repeaters() + """
SELECT count(*) AS total_repeaters,
       count(CASE WHEN severity IN ('CRITICAL', 'VERY ALARMING') THEN 1 END) AS critical_repeaters,
       count(CASE WHEN severity = 'VERY ALARMING' THEN 1 END) AS very_alarming,
       count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical,
       count(CASE WHEN severity = 'ALARMING' THEN 1 END) AS alarming,
       count(CASE WHEN severity = 'NORMAL REPEAT' THEN 1 END) AS normal_repeat,
       (SELECT sr_sub_type FROM rp WHERE sr_sub_type IS NOT NULL GROUP BY sr_sub_type
        ORDER BY count(*) DESC, sr_sub_type LIMIT 1) AS top_sub_type
FROM rp""")
def q_repeat_kpis(spark, sf_dir):
    return repeat_kpis(repeat_complainers(complaints(spark, sf_dir, EV)))


# -- MTTR ------------------------------------------------------------------
def _mttr_sql(view: str) -> str:
    return with_complaints(view, """
f AS (SELECT CAST(sr_close_dttm AS DATE) AS date, date_diff('second', sr_open_dttm, sr_close_dttm) AS secs,
             region, city, exc_id
      FROM c WHERE sr_close_dttm IS NOT NULL AND date_diff('second', sr_open_dttm, sr_close_dttm) >= 300)""", """
l AS (SELECT date, 'Total' AS dimension, 'All' AS dimension_key, secs FROM f
      UNION ALL SELECT date, 'Region', region, secs FROM f
      UNION ALL SELECT date, 'City', city, secs FROM f
      UNION ALL SELECT date, 'Exchange', exc_id, secs FROM f)""") + """
SELECT date, dimension, dimension_key,
       floor(sum(secs) / count(*) / 3.6E3 * 1.0E2 + 5.0E-1) / 1.0E2 AS avg_mttr_hours,
       count(*) AS total_resolved_count
FROM l WHERE dimension_key IS NOT NULL AND dimension_key <> ''
GROUP BY date, dimension, dimension_key"""


@register("daily_mttr", _mttr_sql(EV))
def q_daily_mttr(spark, sf_dir):
    return mttr(complaints(spark, sf_dir, EV))


@register("daily_mttr_orders", _mttr_sql(ORD))
def q_daily_mttr_orders(spark, sf_dir):
    return mttr(complaints(spark, sf_dir, ORD))


# -- ageing ----------------------------------------------------------------
def _aging_sql(view: str) -> str:
    return with_complaints(view, """
d AS (SELECT CAST(unnest(generate_series((SELECT min(sr_open_dt) FROM c), (SELECT max(sr_open_dt) FROM c),
                                         INTERVAL 1 DAY)) AS DATE) AS date)""", """
b AS (SELECT d.date, c.region, c.city, c.exc_id,
             date_diff('second', c.sr_open_dttm, CAST(d.date AS TIMESTAMP) + INTERVAL 86399 SECOND) / 3.6E3
               AS age_hours
      FROM c JOIN d ON c.sr_open_dt <= d.date
      WHERE (c.sr_close_dttm IS NULL OR c.sr_close_dttm > CAST(d.date AS TIMESTAMP) + INTERVAL 86399 SECOND)
        AND c.sr_status <> 'Closed')""", """
s AS (SELECT *, CASE WHEN age_hours > 1440 THEN '> 60 Days' WHEN age_hours > 720 THEN '> 30 Days'
                     WHEN age_hours > 240 THEN '> 10 Days' WHEN age_hours > 144 THEN '> 6 Days'
                     WHEN age_hours > 72 THEN '> 72 Hours' WHEN age_hours > 48 THEN '> 48 Hours'
                     WHEN age_hours > 24 THEN '> 24 Hours' ELSE 'Within 24 Hours' END AS slab FROM b)""", """
l AS (SELECT date, 'Total' AS dimension, 'All' AS dimension_key, slab FROM s
      UNION ALL SELECT date, 'Region', region, slab FROM s
      UNION ALL SELECT date, 'City', city, slab FROM s
      UNION ALL SELECT date, 'Exchange', exc_id, slab FROM s)""") + """
SELECT date, dimension, dimension_key, slab, count(*) AS count
FROM l WHERE dimension_key IS NOT NULL AND dimension_key <> '' AND slab <> 'Within 24 Hours'
GROUP BY date, dimension, dimension_key, slab"""


@register("daily_aging", _aging_sql(EV))
def q_daily_aging(spark, sf_dir):
    return aging_backfill(complaints(spark, sf_dir, EV))


@register("daily_aging_orders", _aging_sql(ORD))
def q_daily_aging_orders(spark, sf_dir):
    return aging_backfill(complaints(spark, sf_dir, ORD))


@register("resolution_kpis", "SELECT coalesce(m.date, a.date) AS date, m.avg_mttr_hours AS overall_mttr_hours, "
          "m.total_resolved_count AS resolved_count, a.open_backlog, a.backlog_over_10_days FROM ("
          + _mttr_sql(EV) + ") m FULL JOIN (SELECT date, CAST(sum(count) AS BIGINT) AS open_backlog, "
          "CAST(sum(CASE WHEN slab IN ('> 10 Days', '> 30 Days', '> 60 Days') THEN count ELSE 0 END) AS BIGINT) "
          "AS backlog_over_10_days FROM (" + _aging_sql(EV) + ") x WHERE dimension = 'Total' GROUP BY date) a "
          "ON m.date = a.date AND m.dimension = 'Total' WHERE m.dimension = 'Total' OR m.dimension IS NULL")
def q_resolution_kpis(spark, sf_dir):
    from murmur.operators.resolution import resolution_kpis
    c = complaints(spark, sf_dir, EV)
    return resolution_kpis(mttr(c), aging_backfill(c))


# -- one date, stored-table views ---------------------------------------------
def _last_open_date(c):
    """The last date with complaints, as a scalar subquery (no driver round trip)."""
    return c.agg(F.max("sr_open_dt")).scalar()


@register("aging_last_date", "SELECT * FROM (" + _aging_sql(ORD) + ") x WHERE date = (SELECT max(date) FROM ("
          + with_complaints(ORD) + "SELECT max(sr_open_dt) AS date FROM c) m)")
def q_aging_last_date(spark, sf_dir):
    c = complaints(spark, sf_dir, ORD)
    return aging(c, _last_open_date(c))


@register("mttr_trend", "SELECT * FROM (" + _mttr_sql(EV) + ") x WHERE dimension = 'Total' AND date > (SELECT t - 30 FROM ("
          + with_complaints(EV) + "SELECT max(sr_open_dt) AS t FROM c) m) AND date <= (SELECT t FROM ("
          + with_complaints(EV) + "SELECT max(sr_open_dt) AS t FROM c) m)")
def q_mttr_trend(spark, sf_dir):
    c = complaints(spark, sf_dir, EV)
    return mttr_trend(mttr(c), _last_open_date(c))


@register("mttr_breakdown_exchange", "SELECT * FROM (" + _mttr_sql(ORD) + ") x WHERE dimension = 'Exchange'")
def q_mttr_breakdown_exchange(spark, sf_dir):
    return mttr_breakdown(mttr(complaints(spark, sf_dir, ORD)), "Exchange")

"""Registered queries: variations and surges (period comparisons)."""

from __future__ import annotations

from murmur.operators.counts import daily_counts
from murmur.operators.surges import level_counts, surge_summary, surges_from_levels
from murmur.operators.variations import variations_from_counts
from murmur.plans.catalog import register
from murmur.plans.oracle import dc_cte, with_complaints
from murmur.sources.tables import complaints

EV = "complaints_ev"
ORD = "complaints_ord"


def _variation_sql(view: str) -> str:
    return with_complaints(view, dc_cte(include_total=True), """
a AS (SELECT h.dimension, h.dimension_key, h.day AS t FROM dc h)""", """
b AS (SELECT a.dimension, a.dimension_key, a.t,
             CAST(a.t - INTERVAL 7 DAY AS DATE) AS dod_day,
             CAST(date_trunc('week', a.t) AS DATE) AS wk,
             CAST(date_trunc('month', a.t) AS DATE) AS ms,
             CAST(date_trunc('month', a.t) - INTERVAL 1 MONTH AS DATE) AS pms
      FROM a)""", """
j AS (SELECT b.dimension, b.dimension_key, b.t,
        sum(CASE WHEN x.day = b.t THEN CAST(x.n AS DOUBLE) END) AS cur,
        sum(CASE WHEN x.day = b.dod_day THEN CAST(x.n AS DOUBLE) END) AS dod_p,
        sum(CASE WHEN x.day BETWEEN b.wk AND b.t THEN CAST(x.n AS DOUBLE) END) AS wcs,
        count(CASE WHEN x.day BETWEEN b.wk AND b.t THEN 1 END) AS wcc,
        sum(CASE WHEN x.day BETWEEN b.wk - 7 AND b.t - 7 THEN CAST(x.n AS DOUBLE) END) AS wps,
        count(CASE WHEN x.day BETWEEN b.wk - 7 AND b.t - 7 THEN 1 END) AS wpc,
        sum(CASE WHEN x.day BETWEEN b.ms AND b.t THEN CAST(x.n AS DOUBLE) END) AS mcs,
        count(CASE WHEN x.day BETWEEN b.ms AND b.t THEN 1 END) AS mcc,
        sum(CASE WHEN x.day BETWEEN b.pms AND b.pms + CAST(b.t - b.ms AS INTEGER) THEN CAST(x.n AS DOUBLE) END) AS mps,
        count(CASE WHEN x.day BETWEEN b.pms AND b.pms + CAST(b.t - b.ms AS INTEGER) THEN 1 END) AS mpc
      FROM b LEFT JOIN dc x ON x.dimension = b.dimension AND x.dimension_key = b.dimension_key
                           AND x.day BETWEEN b.t - 62 AND b.t
      GROUP BY b.dimension, b.dimension_key, b.t)""", """
v AS (SELECT t AS variation_date, dimension, coalesce(dimension_key, 'None') AS dimension_key,
        coalesce(cur, 0.0E0) AS dod_c, coalesce(dod_p, 0.0E0) AS dod_p,
        CASE WHEN wcc > 0 THEN wcs / wcc ELSE 0.0E0 END AS wow_c,
        CASE WHEN wpc > 0 THEN wps / wpc ELSE 0.0E0 END AS wow_p,
        CASE WHEN mcc > 0 THEN mcs / mcc ELSE 0.0E0 END AS mom_c,
        CASE WHEN mpc > 0 THEN mps / mpc ELSE 0.0E0 END AS mom_p
      FROM j)""", """
u AS (SELECT variation_date, dimension, dimension_key, dod_c AS cv, dod_p AS pv, 'DOD' AS variation_type FROM v
      UNION ALL SELECT variation_date, dimension, dimension_key, wow_c, wow_p, 'WOW' FROM v
      UNION ALL SELECT variation_date, dimension, dimension_key, mom_c, mom_p, 'MOM' FROM v)""") + """
SELECT variation_date, dimension, dimension_key, cv AS current_value, pv AS previous_value, variation_type,
       CASE WHEN pv = 0 THEN (CASE WHEN cv > 0 THEN 1.0E2 ELSE 0.0E0 END)
            ELSE (cv - pv) / pv * 1.0E2 END AS variation_percent,
       CAST(CASE WHEN pv = 0 THEN (CASE WHEN cv > 0 THEN 1 ELSE 0 END)
                 WHEN abs((cv - pv) / pv * 1.0E2) >= 1.5E1 THEN 1 ELSE 0 END AS INTEGER) AS is_significant
FROM u"""


@register("daily_variations", _variation_sql(EV))
def q_daily_variations(spark, sf_dir):
    return variations_from_counts(daily_counts(complaints(spark, sf_dir, EV), include_total=True))


@register("daily_variations_orders", _variation_sql(ORD))
def q_daily_variations_orders(spark, sf_dir):
    """Month-over-month across years: the order-based view spans 1995-2001."""
    return variations_from_counts(daily_counts(complaints(spark, sf_dir, ORD), include_total=True))


# -- daily_surges --------------------------------------------------------------
def _r1(x: str) -> str:
    return f"(floor(({x}) * 1.0E1 + 5.0E-1) / 1.0E1)"


def _surge_sql(view: str) -> str:
    same = ("b.level = a.level AND b.region IS NOT DISTINCT FROM a.region "
            "AND b.exc_id IS NOT DISTINCT FROM a.exc_id AND b.city IS NOT DISTINCT FROM a.city")
    pct = lambda cur, p: (f"CASE WHEN {p} = 0 THEN (CASE WHEN {cur} > 0 THEN 9.999E2 ELSE 0.0E0 END) "  # noqa: E731
                          f"ELSE {_r1(f'({cur} - {p}) / {p} * 1.0E2')} END")
    inc = lambda cur, p: (f"CASE WHEN {p} = 0 THEN (CASE WHEN {cur} > 0 THEN CAST({cur} AS DOUBLE) ELSE 0.0E0 END) "  # noqa: E731
                          f"ELSE {_r1(f'{cur} - {p}')} END")
    return with_complaints(view, """
lv AS (
  SELECT 'Total' AS level, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS exc_id,
         CAST(NULL AS VARCHAR) AS city, sr_open_dt AS day, count(*) AS n FROM c GROUP BY sr_open_dt
  UNION ALL SELECT 'Region', region, NULL, NULL, sr_open_dt, count(*) FROM c
            WHERE region IS NOT NULL GROUP BY region, sr_open_dt
  UNION ALL SELECT 'Exchange', region, exc_id, NULL, sr_open_dt, count(*) FROM c
            WHERE region IS NOT NULL AND exc_id IS NOT NULL GROUP BY region, exc_id, sr_open_dt
  UNION ALL SELECT 'City', region, exc_id, city, sr_open_dt, count(*) FROM c
            WHERE region IS NOT NULL AND exc_id IS NOT NULL AND city IS NOT NULL
            GROUP BY region, exc_id, city, sr_open_dt)""", f"""
j AS (SELECT a.*,
        CAST(coalesce((SELECT sum(b.n) FROM lv b WHERE {same} AND b.day = a.day - 7), 0) AS BIGINT) AS lw,
        CAST(coalesce((SELECT sum(b.n) FROM lv b WHERE {same}
                        AND b.day >= CAST(date_trunc('month', a.day) AS DATE) AND b.day < a.day), 0) AS BIGINT)
          AS mtd_sum
      FROM lv a
      WHERE a.n >= CASE a.level WHEN 'Region' THEN 15 WHEN 'Exchange' THEN 10 WHEN 'City' THEN 5 ELSE 0 END)""", """
k AS (SELECT *, CASE WHEN dayofmonth(day) - 1 > 0 THEN mtd_sum / (dayofmonth(day) - 1) ELSE 0.0E0 END AS mavg
      FROM j)""", f"""
m AS (SELECT *, {pct('n', 'mavg')} AS mtd_surge_percent, {inc('n', 'mavg')} AS mtd_surge_increase,
             {pct('n', 'lw')} AS wow_surge_percent, {inc('n', 'lw')} AS wow_surge_increase FROM k)""") + f"""
SELECT day AS surge_date, level, region, exc_id, city,
       CASE level WHEN 'Total' THEN 'Total' WHEN 'Region' THEN region WHEN 'Exchange' THEN exc_id ELSE city END
         AS name,
       CASE level WHEN 'Exchange' THEN region WHEN 'City' THEN region || ' > ' || exc_id END AS parent,
       n AS current_count, {_r1('mavg')} AS mtd_avg, lw AS last_week_count,
       mtd_surge_percent, mtd_surge_increase, wow_surge_percent, wow_surge_increase,
       greatest(mtd_surge_percent, wow_surge_percent) AS max_surge_percent,
       CASE WHEN greatest(mtd_surge_percent, wow_surge_percent) >= 5.0E1 THEN 'CRITICAL' ELSE 'ALARMING' END
         AS severity
FROM m WHERE greatest(mtd_surge_percent, wow_surge_percent) >= 2.0E1"""


@register("daily_surges", _surge_sql(EV))
def q_daily_surges(spark, sf_dir):
    return surges_from_levels(level_counts(complaints(spark, sf_dir, EV)))


@register("surge_summary", "SELECT surge_date, severity, count(*) AS surge_count FROM (\n"
          + _surge_sql(EV) + "\n) s GROUP BY surge_date, severity")
def q_surge_summary(spark, sf_dir):
    return surge_summary(surges_from_levels(level_counts(complaints(spark, sf_dir, EV))))

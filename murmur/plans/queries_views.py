"""Registered queries: trend plots, dashboard views, validation and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators.anomalies import anomalies_from_counts
from murmur.operators.counts import daily_counts
from murmur.operators.dashboard import (anomalies_by_dimension, dashboard_kpis, top_significant_variations,
                                        top_trends, total_variations)
from murmur.operators.plots import key_totals, trend_drilldown, trend_series, trend_stats, trend_wide
from murmur.operators.trends import trends_from_counts
from murmur.operators.validate import (hourly_counts, hourly_gaps, missing_value_counts, profile_table,
                                       validation_issues)
from murmur.operators.variations import variations_from_counts
from murmur.plans.catalog import register
from murmur.plans.oracle import dc_cte, with_complaints
from murmur.plans.queries_core import ANOMALY_CTES, TREND_CTES
from murmur.plans.queries_periods import _variation_sql
from murmur.sources.tables import complaints

EV = "complaints_ev"
ORD = "complaints_ord"

# -- trend plots ---------------------------------------------------------------
_LEVEL_KEYS = [("total", []), ("region", ["region"]), ("exchange", ["region", "exc_id"]),
               ("city", ["region", "exc_id", "city"]), ("subtype", ["sr_sub_type"]), ("rca", ["rca"])]
_PLOT_COLS = ["region", "exc_id", "city", "sr_sub_type", "rca"]


def _series_ctes():
    parts = []
    for name, keys in _LEVEL_KEYS:
        sel = ", ".join(c if c in keys else f"CAST(NULL AS VARCHAR) AS {c}" for c in _PLOT_COLS)
        where = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "TRUE"
        grp = ", ".join(keys + ["sr_open_dt"])
        parts.append(f"SELECT '{name}' AS level, {sel}, sr_open_dt AS \"date\", count(*) AS \"count\" "
                     f"FROM win WHERE {where} GROUP BY {grp}")
    return ("""
mx AS (SELECT max(sr_open_dt) AS t FROM c)""", """
win AS (SELECT c.* FROM c JOIN mx ON c.sr_open_dt BETWEEN mx.t - 30 AND mx.t)""",
            "ser AS (" + "\n  UNION ALL ".join(parts) + ")")


def _series(spark, sf_dir):
    return trend_series(complaints(spark, sf_dir, EV))


@register("trend_series", with_complaints(EV, *_series_ctes()) + "SELECT * FROM ser")
def q_trend_series(spark, sf_dir):
    return _series(spark, sf_dir)


@register("trend_drilldown")
def q_trend_drilldown(spark, sf_dir):
    """Nested points per key (rows-only check: nested output)."""
    return trend_drilldown(_series(spark, sf_dir))


@register("trend_drilldown_points", with_complaints(EV, *_series_ctes()) + "SELECT * FROM ser")
def q_trend_drilldown_points(spark, sf_dir):
    """The nested points, one row a point again."""
    return trend_drilldown(_series(spark, sf_dir)).select("level", *_PLOT_COLS, F.inline("points"))


# the five region names of the TPC-H region table
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@register("trend_wide_region", with_complaints(EV, *_series_ctes()) + "SELECT \"date\", " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN region = '{r}' THEN \"count\" END), 0) AS BIGINT) AS \"{r}\"" for r in _REGIONS)
    + " FROM ser WHERE level = 'region' GROUP BY \"date\"")
def q_trend_wide_region(spark, sf_dir):
    return trend_wide(_series(spark, sf_dir), "region", _REGIONS)


@register("trend_stats", with_complaints(EV, *_series_ctes()) + """
SELECT avg("count") AS mean_daily, max("count") AS max_daily, min("count") AS min_daily, count(*) AS days
FROM ser WHERE level = 'total'""")
def q_trend_stats(spark, sf_dir):
    return trend_stats(_series(spark, sf_dir))


@register("subtype_totals", with_complaints(EV, *_series_ctes()) + """
SELECT sr_sub_type, CAST(sum("count") AS BIGINT) AS total FROM ser WHERE level = 'subtype' GROUP BY sr_sub_type""")
def q_subtype_totals(spark, sf_dir):
    return key_totals(_series(spark, sf_dir), "subtype")


@register("rca_totals", with_complaints(EV, *_series_ctes()) + """
SELECT rca, CAST(sum("count") AS BIGINT) AS total FROM ser WHERE level = 'rca' GROUP BY rca""")
def q_rca_totals(spark, sf_dir):
    return key_totals(_series(spark, sf_dir), "rca")


# -- dashboard -----------------------------------------------------------------
@register("dashboard_kpis", with_complaints(EV, *ANOMALY_CTES, *TREND_CTES, """
cc AS (SELECT sr_open_dt AS d, count(*) AS complaints FROM c GROUP BY sr_open_dt)""", """
ac AS (SELECT anomaly_date AS d, count(*) AS anomalies,
              count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical_anomalies
       FROM an GROUP BY anomaly_date)""", """
uc AS (SELECT trend_date AS d, count(*) AS up_trends FROM tr
       WHERE window_days = 30 AND trend_direction = 'UP' GROUP BY trend_date)""") + """
SELECT coalesce(cc.d, ac.d, uc.d) AS "date", coalesce(complaints, 0) AS complaints,
       coalesce(anomalies, 0) AS anomalies, coalesce(critical_anomalies, 0) AS critical_anomalies,
       coalesce(up_trends, 0) AS up_trends
FROM cc FULL JOIN ac ON cc.d = ac.d FULL JOIN uc ON coalesce(cc.d, ac.d) = uc.d""")
def q_dashboard_kpis(spark, sf_dir):
    c = complaints(spark, sf_dir, EV)
    counts = daily_counts(c)
    return dashboard_kpis(c, anomalies_from_counts(counts), trends_from_counts(counts))


@register("anomalies_by_dimension", with_complaints(EV, *ANOMALY_CTES) + """
SELECT anomaly_date, dimension, count(*) AS anomaly_count FROM an GROUP BY anomaly_date, dimension""")
def q_anomalies_by_dimension(spark, sf_dir):
    return anomalies_by_dimension(anomalies_from_counts(daily_counts(complaints(spark, sf_dir, EV))))


def _variations(spark, sf_dir):
    return variations_from_counts(daily_counts(complaints(spark, sf_dir, EV), include_total=True))


@register("total_variations", "SELECT * FROM (\n" + _variation_sql(EV) + "\n) v WHERE dimension = 'Total'")
def q_total_variations(spark, sf_dir):
    return total_variations(_variations(spark, sf_dir))


@register("top_significant_variations", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY variation_date "
          "ORDER BY abs(variation_percent) DESC, dimension, dimension_key, variation_type) AS INTEGER) AS rank "
          "FROM (\n" + _variation_sql(EV) + "\n) v WHERE dimension <> 'Total' AND is_significant = 1) WHERE rank <= 5")
def q_top_significant_variations(spark, sf_dir):
    return top_significant_variations(_variations(spark, sf_dir))


@register("top_trends", with_complaints(EV, dc_cte(), *TREND_CTES) + """
SELECT *, CAST(significance < 5.0E-2 AS INTEGER) AS is_significant FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY trend_date ORDER BY abs(trend_strength) DESC, dimension,
                                   dimension_key) AS INTEGER) AS rank
  FROM tr WHERE window_days = 30 AND trend_direction <> 'STABLE') WHERE rank <= 10""")
def q_top_trends(spark, sf_dir):
    return top_trends(trends_from_counts(daily_counts(complaints(spark, sf_dir, EV))))


# -- validation and profiling ------------------------------------------------------
@register("missing_value_counts", with_complaints(EV) + """
SELECT 'region' AS column_name, count(*) FILTER (WHERE region IS NULL) AS null_count FROM c
UNION ALL SELECT 'sr_type', count(*) FILTER (WHERE sr_type IS NULL) FROM c
UNION ALL SELECT 'rca', count(*) FILTER (WHERE rca IS NULL) FROM c""")
def q_missing_value_counts(spark, sf_dir):
    return missing_value_counts(complaints(spark, sf_dir, EV))


@register("hourly_counts", with_complaints(EV) + """
SELECT date_trunc('hour', sr_open_dttm) AS hour, count(*) AS count FROM c GROUP BY 1""")
def q_hourly_counts(spark, sf_dir):
    return hourly_counts(complaints(spark, sf_dir, EV))


_GAPS_CTE = """
gaps AS (SELECT CAST(h AS TIMESTAMP) AS hour FROM (
           SELECT unnest(generate_series(CAST((SELECT min(sr_open_dt) FROM c) AS TIMESTAMP),
                                         CAST((SELECT max(sr_open_dt) FROM c) AS TIMESTAMP) + INTERVAL 23 HOUR,
                                         INTERVAL 1 HOUR)) AS h)
         WHERE CAST(h AS TIMESTAMP) NOT IN (SELECT date_trunc('hour', sr_open_dttm) FROM c))"""


@register("hourly_gaps_orders", with_complaints(ORD, _GAPS_CTE) + "SELECT hour FROM gaps")
def q_hourly_gaps_orders(spark, sf_dir):
    return hourly_gaps(complaints(spark, sf_dir, ORD))


@register("validation_issues_orders", with_complaints(ORD, _GAPS_CTE) + """
SELECT 'missing_values' AS "check", printf('Found %d rows with missing %s', null_count, column_name) AS issue
FROM (SELECT 'region' AS column_name, count(*) FILTER (WHERE region IS NULL) AS null_count FROM c
      UNION ALL SELECT 'sr_type', count(*) FILTER (WHERE sr_type IS NULL) FROM c
      UNION ALL SELECT 'rca', count(*) FILTER (WHERE rca IS NULL) FROM c) WHERE null_count > 0
UNION ALL
SELECT 'missing_hours', printf('Missing data for %d hours: %s...', count(*),
       array_to_string(list_slice(list_sort(list(strftime(hour, '%Y-%m-%d %H:00:00'))), 1, 5), ', '))
FROM gaps HAVING count(*) > 0""")
def q_validation_issues_orders(spark, sf_dir):
    return validation_issues(complaints(spark, sf_dir, ORD))


@register("profile_table", with_complaints(EV) + """
SELECT count(*) AS row_count, min(sr_open_dt) AS min_date, max(sr_open_dt) AS max_date,
       count(DISTINCT sr_open_dt) AS distinct_dates FROM c""")
def q_profile_table(spark, sf_dir):
    return profile_table(complaints(spark, sf_dir, EV))


def _register_level(level: str, cols: list[str]):
    sel = ", ".join(cols + ['"date"', '"count"'])

    @register(f"{level}_trend", with_complaints(EV, *_series_ctes()) + f"SELECT {sel} FROM ser WHERE level = '{level}'")
    def q(spark, sf_dir):
        from murmur.operators.plots import level_trend, total_trend
        s = _series(spark, sf_dir)
        return total_trend(s) if level == "total" else level_trend(s, level)
    return q


for _lvl, _cols in _LEVEL_KEYS:
    _register_level(_lvl, _cols)

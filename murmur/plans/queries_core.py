"""Registered queries: daily counts, baselines, anomalies and trends."""

from __future__ import annotations

from murmur.operators.anomalies import anomalies_from_counts
from murmur.operators.baselines import daily_baselines
from murmur.operators.counts import daily_counts
from murmur.operators.trends import trends_from_counts
from murmur.functions.stats import round_half_up_sql, student_t_p_sql, theta_from_r_sql
from murmur.plans.catalog import register
from murmur.plans.oracle import avg_sql, dc_cte, std_sql, with_complaints
from murmur.sources.tables import complaints

EV = "complaints_ev"


def _stat_cols(windows=(7, 14, 30)) -> tuple[str, str]:
    aggs, outs = [], []
    for w in windows:
        aggs.append(f"count(CASE WHEN lag <= {w} THEN 1 END) AS c{w}, "
                    f"coalesce(sum(CASE WHEN lag <= {w} THEN n END), 0) AS s{w}, "
                    f"coalesce(sum(CASE WHEN lag <= {w} THEN n * n END), 0) AS ss{w}")
        outs.append(f"{avg_sql(f'c{w}', f's{w}')} AS avg_{w}d, {std_sql(f'c{w}', f's{w}', f'ss{w}')} AS std_{w}d, "
                    f"c{w} AS samples_{w}d")
    return ", ".join(aggs), ", ".join(outs)


# -- daily_counts ------------------------------------------------------------
@register("daily_counts", with_complaints(EV, dc_cte()) +
          "SELECT dimension, dimension_key, day, n FROM dc")
def q_daily_counts(spark, sf_dir):
    return daily_counts(complaints(spark, sf_dir, EV))


# -- daily_baselines ---------------------------------------------------------
_aggs, _outs = _stat_cols()
_BASELINE_SQL = with_complaints(EV, dc_cte(), "t AS (SELECT DISTINCT day AS as_of FROM dc)", f"""
p AS (SELECT h.dimension, h.dimension_key, t.as_of, CAST(h.n AS DOUBLE) AS n,
             CAST(t.as_of - h.day AS BIGINT) AS lag
      FROM dc h JOIN t ON h.day >= t.as_of - 30 AND h.day < t.as_of)""", f"""
g AS (SELECT dimension, dimension_key, as_of, {_aggs} FROM p GROUP BY dimension, dimension_key, as_of)""") + \
    f"SELECT dimension, dimension_key, as_of, {_outs} FROM g"


@register("daily_baselines", _BASELINE_SQL)
def q_daily_baselines(spark, sf_dir):
    return daily_baselines(daily_counts(complaints(spark, sf_dir, EV)))


# -- daily_anomalies ---------------------------------------------------------
ANOMALY_CTES = (dc_cte(), """
h AS (SELECT t.dimension, t.dimension_key, t.day, t.n,
             count(x.n) AS cnt,
             coalesce(sum(CAST(x.n AS DOUBLE)), 0) AS s,
             coalesce(sum(CAST(x.n AS DOUBLE) * x.n), 0) AS ss
      FROM dc t LEFT JOIN dc x
        ON x.dimension = t.dimension AND x.dimension_key = t.dimension_key
       AND x.day >= t.day - 30 AND x.day < t.day
      GROUP BY t.dimension, t.dimension_key, t.day, t.n)""", f"""
b AS (SELECT day AS anomaly_date, dimension, coalesce(dimension_key, 'None') AS dimension_key,
             CAST(n AS DOUBLE) AS metric_value,
             {avg_sql('cnt', 's')} AS baseline_avg, {std_sql('cnt', 's', 'ss')} AS baseline_std
      FROM h)""", """
z AS (SELECT *, (metric_value - baseline_avg) / (baseline_std + 1.0E-3) AS z_score FROM b)""", """
an AS (SELECT anomaly_date, dimension, dimension_key, metric_value, baseline_avg, baseline_std, z_score,
              CASE WHEN z_score > 3.0E0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, '' AS rca_context
       FROM z WHERE z_score > 2.0E0)""")
_ANOMALY_SQL = with_complaints(EV, *ANOMALY_CTES) + "SELECT * FROM an"


@register("daily_anomalies", _ANOMALY_SQL)
def q_daily_anomalies(spark, sf_dir):
    return anomalies_from_counts(daily_counts(complaints(spark, sf_dir, EV)))


# -- daily_trends ------------------------------------------------------------
TREND_CTES = ("""
k AS (SELECT *, row_number() OVER (PARTITION BY dimension, dimension_key ORDER BY day) AS rn
      FROM dc WHERE dimension_key IS NOT NULL)""", """
t AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM k), (SELECT max(day) FROM k),
                                          INTERVAL 1 DAY)) AS DATE) AS trend_date)""", """
w AS (SELECT unnest([7, 14, 30]) AS window_days)""", """
pts AS (SELECT k.dimension, k.dimension_key, t.trend_date, w.window_days, k.day, k.n, k.rn
        FROM k JOIN t ON k.day <= t.trend_date AND k.day >= t.trend_date - 30
               JOIN w ON k.day >= t.trend_date - w.window_days)""", """
g AS (SELECT dimension, dimension_key, trend_date, window_days, count(*) AS days_used,
             sum(CAST(n AS DOUBLE)) AS sy, sum(CAST(n AS DOUBLE) * n) AS syy,
             sum(CAST(rn AS DOUBLE) * n) AS sxy_raw, CAST(min(rn) AS DOUBLE) AS xmin,
             arg_min(n, day) AS first_n, arg_max(n, day) AS last_n
      FROM pts GROUP BY dimension, dimension_key, trend_date, window_days HAVING count(*) >= 3)""", """
s1 AS (SELECT *, CAST(days_used AS DOUBLE) AS nn FROM g)""", """
s2 AS (SELECT *, (nn - 1.0E0) * nn * (2.0E0 * nn - 1.0E0) / 6.0E0 AS sxx_raw,
              nn * (nn - 1.0E0) / 2.0E0 AS sx FROM s1)""", """
s3 AS (SELECT *, nn * sxx_raw - sx * sx AS sxx, nn * (sxy_raw - xmin * sy) - sx * sy AS cxy,
              nn * syy - sy * sy AS cyy FROM s2)""", """
s4 AS (SELECT *, CASE WHEN sxx > 0 THEN cxy / sxx ELSE 0.0E0 END AS slope,
              CASE WHEN sxx > 0 AND cyy > 0 THEN least(1.0E0, greatest(-1.0E0, cxy / sqrt(sxx * cyy)))
                   ELSE 0.0E0 END AS r_value FROM s3)""", f"""
s5 AS (SELECT *, {theta_from_r_sql('r_value')} AS theta, days_used - 2 AS nu FROM s4)""", f"""
s6 AS (SELECT *, {round_half_up_sql(student_t_p_sql('theta', 'nu', 29), 9)} AS significance FROM s5)""", """
tr AS (SELECT trend_date, dimension, dimension_key, CAST(last_n AS DOUBLE) AS metric_value,
       CASE WHEN significance < 5.0E-2 AND slope > 0 THEN 'UP'
            WHEN significance < 5.0E-2 AND slope < 0 THEN 'DOWN' ELSE 'STABLE' END AS trend_direction,
       CASE WHEN first_n <> 0 THEN (last_n - CAST(first_n AS DOUBLE)) / CAST(first_n AS DOUBLE) * 1.0E2
            ELSE 0.0E0 END AS trend_strength,
       CAST(window_days AS INTEGER) AS window_days, significance, slope, r_value, days_used
FROM s6)""")
_TREND_SQL = with_complaints(EV, dc_cte(), *TREND_CTES) + "SELECT * FROM tr"


@register("daily_trends", _TREND_SQL)
def q_daily_trends(spark, sf_dir):
    return trends_from_counts(daily_counts(complaints(spark, sf_dir, EV)))

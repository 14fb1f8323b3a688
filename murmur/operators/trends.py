"""Linear trends of daily counts over 7 / 14 / 30 day windows.

For target date t and window w, a key's series is its days with data in
[t - w, t] (w + 1 calendar days, target included), sorted by day, with
x = 0..n-1 over the present days.  At least 3 days are needed.  Ordinary least
squares gives slope and r; the two-sided p-value of r comes from Student's t
with n - 2 degrees of freedom in closed form.  Direction is UP / DOWN by the
sign of the slope when p < 0.05, else STABLE; strength is the percent change
from the first to the last value; the metric is the last value.

Plan: number each key's present days once (row_number over the key, one
shuffle by (dimension, key)); copy each count to the target dates and windows
it belongs to (at most 31 + 15 + 8 copies, inside the same partitions); then
aggregate exact sufficient statistics per (dimension, key, target, window).
The aggregation's clustering is implied by the (dimension, key) partitioning,
so it runs without a second shuffle.  Because x is consecutive inside a
window, slope and r computed with the global row number shifted by its window
minimum equal those of x = 0..n-1.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.constants import TREND_MIN_DAYS, TREND_P_THRESHOLD, TREND_WINDOWS
from murmur.functions.stats import round_half_up, student_t_p, theta_from_r_sql
from murmur.operators.common import DateLike, date_scope, lit_date, target_filter
from murmur.operators.counts import daily_counts

TREND_COLUMNS = ["trend_date", "dimension", "dimension_key", "metric_value", "trend_direction",
                 "trend_strength", "window_days", "significance", "slope", "r_value", "days_used"]

# p-values are rounded to this many decimals so every engine stores the same
# digits (trigonometric library calls may differ in the last bit).
P_DIGITS = 9


def ols_columns(n, sy, syy, sxy_raw, xmin):
    """slope, r from count n, sum y, sum y^2, sum(x_raw * y) and min(x_raw).

    x = x_raw - xmin runs 0..n-1, so sum x and sum x^2 are closed forms.
    """
    sx = n * (n - 1) / 2.0
    sxx_raw = (n - 1) * n * (2 * n - 1) / 6.0
    sxy = sxy_raw - xmin * sy
    sxx = n * sxx_raw - sx * sx
    cxy = n * sxy - sx * sy
    cyy = n * syy - sy * sy
    slope = F.when(sxx > 0, cxy / sxx).otherwise(F.lit(0.0))
    r = F.when((sxx > 0) & (cyy > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cxy / F.sqrt(sxx * cyy)))) \
        .otherwise(F.lit(0.0))
    return slope, r


def trends_from_counts(counts: DataFrame, windows: Iterable[int] = TREND_WINDOWS,
                       start: DateLike = None, end: DateLike = None,
                       p_threshold: float = TREND_P_THRESHOLD, min_days: int = TREND_MIN_DAYS) -> DataFrame:
    """Trends for every calendar target date up to ``end`` (default: the last day of ``counts``)."""
    windows = sorted(set(windows))
    maxw = windows[-1]
    counts = counts.filter(F.col("dimension_key").isNotNull())
    last_day = counts.agg(F.max("day")).scalar() if end is None else lit_date(end)
    numbered = counts.withColumn(
        "rn", F.row_number().over(Window.partitionBy("dimension", "dimension_key").orderBy("day")))
    copies = (numbered
              .select("dimension", "dimension_key", "day", "n", "rn",
                      F.explode(F.sequence(F.lit(0), F.lit(maxw))).alias("lag"))
              .select("*", F.date_add("day", F.col("lag")).alias("trend_date"))
              .filter((F.col("trend_date") <= last_day) & target_filter("trend_date", start, end))
              .select("*", F.explode(F.filter(F.array(*[F.lit(w) for w in windows]),
                                              lambda w: w >= F.col("lag"))).alias("window_days")))
    y = F.col("n").cast("double")
    g = copies.groupBy("dimension", "dimension_key", "trend_date", "window_days").agg(
        F.count(F.lit(1)).alias("days_used"),
        F.sum(y).alias("_sy"), F.sum(y * y).alias("_syy"),
        F.sum(F.col("rn").cast("double") * y).alias("_sxy"), F.min("rn").cast("double").alias("_xmin"),
        F.min_by("n", "day").alias("_first"), F.max_by("n", "day").alias("_last"),
    ).filter(F.col("days_used") >= min_days)
    n = F.col("days_used").cast("double")
    slope, r = ols_columns(n, F.col("_sy"), F.col("_syy"), F.col("_sxy"), F.col("_xmin"))
    g = g.select("*", slope.alias("slope"), r.alias("r_value"))
    g = g.withColumn("_theta", F.expr(theta_from_r_sql("r_value"))) \
         .withColumn("_nu", F.col("days_used") - 2)
    p = student_t_p(F.col("_theta"), F.col("_nu"))
    g = g.withColumn("significance", round_half_up(p, P_DIGITS))
    direction = (F.when((F.col("significance") < p_threshold) & (F.col("slope") > 0), "UP")
                 .when((F.col("significance") < p_threshold) & (F.col("slope") < 0), "DOWN")
                 .otherwise("STABLE"))
    first = F.col("_first").cast("double")
    strength = F.when(first != 0, (F.col("_last") - first) / first * 100.0).otherwise(F.lit(0.0))
    return g.select(
        "trend_date", "dimension", "dimension_key",
        F.col("_last").cast("double").alias("metric_value"),
        direction.alias("trend_direction"), strength.alias("trend_strength"),
        F.col("window_days").cast("int").alias("window_days"), "significance",
        "slope", "r_value", F.col("days_used").cast("bigint").alias("days_used"),
    )


def daily_trends(complaints: DataFrame, start: DateLike = None, end: DateLike = None,
                 dimensions=None, windows: Iterable[int] = TREND_WINDOWS,
                 p_threshold: float = TREND_P_THRESHOLD) -> DataFrame:
    """Trends for target dates in [start, end]; reads only the needed history."""
    maxw = max(windows)
    scoped = date_scope(complaints, start, end, lookback_days=maxw)
    return trends_from_counts(daily_counts(scoped, dimensions), windows, start, end, p_threshold)

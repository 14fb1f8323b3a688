"""Z-score anomalies of daily counts against the trailing 30-day baseline.

z = (count - avg_30d) / (std_30d + 0.001); rows with z > warning are kept,
CRITICAL when z > critical, else WARNING (upward deviations only).  A null key
is reported as 'None' and never matches a baseline (avg = std = 0).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.constants import Z_CRITICAL, Z_EPSILON, Z_WARNING
from murmur.operators.baselines import trailing_stats
from murmur.operators.common import DateLike, date_scope, target_filter
from murmur.operators.counts import daily_counts

ANOMALY_COLUMNS = ["anomaly_date", "dimension", "dimension_key", "metric_value", "baseline_avg",
                   "baseline_std", "z_score", "severity", "rca_context"]


def z_score(count, avg, std, epsilon: float = Z_EPSILON):
    return (count - avg) / (std + F.lit(epsilon))


def severity_of(z, warning: float = Z_WARNING, critical: float = Z_CRITICAL):
    return F.when(z > critical, "CRITICAL").when(z > warning, "WARNING").otherwise("INFO")


def anomalies_from_counts(counts: DataFrame, start: DateLike = None, end: DateLike = None,
                          warning: float = Z_WARNING, critical: float = Z_CRITICAL,
                          window: int = 30, drop_null_keys: bool = False) -> DataFrame:
    """Anomalies for every date of ``counts`` in [start, end] (backfill form)."""
    if drop_null_keys:
        counts = counts.filter(F.col("dimension_key").isNotNull())
    stats = trailing_stats(counts, window).filter(target_filter("day", start, end))
    null_key = F.col("dimension_key").isNull()
    avg = F.when(null_key, 0.0).otherwise(F.col(f"avg_{window}d"))
    std = F.when(null_key, 0.0).otherwise(F.col(f"std_{window}d"))
    scored = stats.select(
        F.col("day").alias("anomaly_date"), "dimension",
        F.coalesce(F.col("dimension_key"), F.lit("None")).alias("dimension_key"),
        F.col("n").cast("double").alias("metric_value"),
        avg.alias("baseline_avg"), std.alias("baseline_std"),
    ).withColumn("z_score", z_score(F.col("metric_value"), F.col("baseline_avg"), F.col("baseline_std")))
    return (scored.filter(F.col("z_score") > warning)
            .withColumn("severity", severity_of(F.col("z_score"), warning, critical))
            .withColumn("rca_context", F.lit(""))
            .select(*ANOMALY_COLUMNS))


def daily_anomalies(complaints: DataFrame, start: DateLike = None, end: DateLike = None,
                    dimensions: Iterable[str] | None = None, warning: float = Z_WARNING,
                    critical: float = Z_CRITICAL, window: int = 30,
                    drop_null_keys: bool = False) -> DataFrame:
    """Anomalies for target dates in [start, end]; one date when start == end.

    Only the target range plus ``window`` days of history are scanned.
    """
    scoped = date_scope(complaints, start, end, lookback_days=window)
    counts = daily_counts(scoped, dimensions)
    return anomalies_from_counts(counts, start, end, warning, critical, window, drop_null_keys)


def asof_baselines(current: DataFrame, baselines: DataFrame, window: int = 30,
                   max_age_days: int | None = None) -> DataFrame:
    """``current`` (dimension, dimension_key, day, n) plus ``as_of``, ``avg`` and ``std`` of the
    latest stored baseline of the key that is not after the day (null: none).

    One shuffle by (dimension, key) for both sides and a running ``last``; a
    key's partition holds its dates alone.  With ``max_age_days`` older
    baselines do not count.  A null key has no baseline.
    """
    held = baselines.select("dimension", "dimension_key", F.col("as_of").alias("day"), F.lit(None).cast("bigint").alias("n"),
                            F.lit(0).alias("_side"), F.struct("as_of", F.col(f"avg_{window}d").alias("avg"),
                                                              F.col(f"std_{window}d").alias("std")).alias("_held"))
    asked = current.select("dimension", "dimension_key", "day", F.col("n").cast("bigint").alias("n"), F.lit(1).alias("_side"),
                           F.lit(None).cast(held.schema["_held"].dataType).alias("_held"))
    w = Window.partitionBy("dimension", "dimension_key").orderBy("day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("dimension_key").isNotNull()
    if max_age_days is not None:
        known = known & (F.datediff("day", F.col("_last.as_of")) <= max_age_days)
    rows = asked.unionByName(held.filter(F.col("dimension_key").isNotNull())) \
        .withColumn("_last", F.last("_held", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    return rows.select("dimension", "dimension_key", "day", "n",
                       *[F.when(known, F.col(f"_last.{c}")).alias(c) for c in ("as_of", "avg", "std")])


def anomalies_from_baselines(current: DataFrame, baselines: DataFrame,
                             warning: float = Z_WARNING, critical: float = Z_CRITICAL,
                             window: int = 30, max_age_days: int | None = None) -> DataFrame:
    """Anomalies from stored baselines: each count of ``current`` (dimension, dimension_key,
    day, n) against the latest baseline of its key not after the day; a missing
    baseline (or a null key) counts as avg = std = 0."""
    scored = asof_baselines(current, baselines, window, max_age_days).select(
        F.col("day").alias("anomaly_date"), "dimension",
        F.coalesce(F.col("dimension_key"), F.lit("None")).alias("dimension_key"),
        F.col("n").cast("double").alias("metric_value"),
        F.coalesce(F.col("avg"), F.lit(0.0)).alias("baseline_avg"),
        F.coalesce(F.col("std"), F.lit(0.0)).alias("baseline_std"),
    ).withColumn("z_score", z_score(F.col("metric_value"), F.col("baseline_avg"), F.col("baseline_std")))
    return (scored.filter(F.col("z_score") > warning)
            .withColumn("severity", severity_of(F.col("z_score"), warning, critical))
            .withColumn("rca_context", F.lit(""))
            .select(*ANOMALY_COLUMNS))

"""Dashboard queries over the result tables, per date (backfill form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dashboard_kpis(complaints: DataFrame, anomalies: DataFrame, trends: DataFrame) -> DataFrame:
    """Per date: complaints, anomalies, critical anomalies, 30-day UP trends.

    Four per-date aggregates joined on the date (each is one row per date).
    """
    c = complaints.groupBy(F.col("sr_open_dt").alias("date")).agg(F.count(F.lit(1)).alias("complaints"))
    a = anomalies.groupBy(F.col("anomaly_date").alias("date")).agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.count(F.when(F.col("severity") == "CRITICAL", 1)).alias("critical_anomalies"))
    t = trends.filter((F.col("window_days") == 30) & (F.col("trend_direction") == "UP")) \
        .groupBy(F.col("trend_date").alias("date")).agg(F.count(F.lit(1)).alias("up_trends"))
    j = c.join(a, "date", "full_outer").join(t, "date", "full_outer")
    return j.select("date", *[F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x)
                              for x in ("complaints", "anomalies", "critical_anomalies", "up_trends")])


def anomalies_by_dimension(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_date", "dimension").agg(F.count(F.lit(1)).alias("anomaly_count"))


def total_variations(variations: DataFrame) -> DataFrame:
    return variations.filter(F.col("dimension") == "Total")


def top_significant_variations(variations: DataFrame, k: int = 5) -> DataFrame:
    """Per date, the ``k`` largest |percent| significant non-Total variations."""
    w = Window.partitionBy("variation_date").orderBy(
        F.desc(F.abs("variation_percent")), "dimension", "dimension_key", "variation_type")
    v = variations.filter((F.col("dimension") != "Total") & (F.col("is_significant") == 1))
    return v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_trends(trends: DataFrame, k: int = 10, window_days: int = 30, p_threshold: float = 0.05) -> DataFrame:
    """Per date, the ``k`` strongest non-STABLE trends of a window, with a significance flag."""
    w = Window.partitionBy("trend_date").orderBy(
        F.desc(F.abs("trend_strength")), "dimension", "dimension_key")
    t = trends.filter((F.col("window_days") == window_days) & (F.col("trend_direction") != "STABLE"))
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .withColumn("is_significant", (F.col("significance") < p_threshold).cast("int"))


def anomaly_table(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy("anomaly_date", F.desc("z_score"))

"""Table schemas (StructType constants)."""

from __future__ import annotations

from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from murmur.constants import COMPLAINT_COLUMNS

_TYPED = {"sr_open_dt": DateType(), "sr_open_dttm": TimestampNTZType(), "sr_close_dttm": TimestampNTZType()}

COMPLAINTS_SCHEMA = StructType([StructField(c, _TYPED.get(c, StringType()), c != "sr_number")
                                for c in COMPLAINT_COLUMNS])

ANOMALIES_SCHEMA = StructType([
    StructField("anomaly_date", DateType()), StructField("dimension", StringType()),
    StructField("dimension_key", StringType()), StructField("metric_value", DoubleType()),
    StructField("baseline_avg", DoubleType()), StructField("baseline_std", DoubleType()),
    StructField("z_score", DoubleType()), StructField("severity", StringType()),
    StructField("rca_context", StringType()),
])

TRENDS_SCHEMA = StructType([
    StructField("trend_date", DateType()), StructField("dimension", StringType()),
    StructField("dimension_key", StringType()), StructField("metric_value", DoubleType()),
    StructField("trend_direction", StringType()), StructField("trend_strength", DoubleType()),
    StructField("window_days", IntegerType()), StructField("significance", DoubleType()),
    StructField("slope", DoubleType()), StructField("r_value", DoubleType()), StructField("days_used", LongType()),
])

VARIATIONS_SCHEMA = StructType([
    StructField("variation_date", DateType()), StructField("dimension", StringType()),
    StructField("dimension_key", StringType()), StructField("current_value", DoubleType()),
    StructField("previous_value", DoubleType()), StructField("variation_type", StringType()),
    StructField("variation_percent", DoubleType()), StructField("is_significant", IntegerType()),
])

INSIGHTS_SCHEMA = StructType([
    StructField("created_at", TimestampNTZType()), StructField("title", StringType()),
    StructField("summary", StringType()), StructField("severity", StringType()),
    StructField("z_score", DoubleType()),
])

MTTR_SCHEMA = StructType([
    StructField("date", DateType()), StructField("dimension", StringType()), StructField("dimension_key", StringType()),
    StructField("avg_mttr_hours", DoubleType()), StructField("total_resolved_count", LongType()),
])

AGING_SCHEMA = StructType([
    StructField("date", DateType()), StructField("dimension", StringType()), StructField("dimension_key", StringType()),
    StructField("slab", StringType()), StructField("count", LongType()),
])

# result table -> (date column, schema); every result table is partitioned by (date, dimension)
RESULT_TABLES = {
    "daily_anomalies": ("anomaly_date", ANOMALIES_SCHEMA),
    "daily_trends": ("trend_date", TRENDS_SCHEMA),
    "daily_variations": ("variation_date", VARIATIONS_SCHEMA),
    "daily_mttr": ("date", MTTR_SCHEMA),
    "daily_aging": ("date", AGING_SCHEMA),
}

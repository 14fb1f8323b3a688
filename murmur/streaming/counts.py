"""Structured Streaming: complaints per (dimension, key, day) with late rows.

A watermark on the open time bounds the state: rows up to ``lateness`` late
still update their day, duplicates of an ``sr_number`` within the watermark
are dropped, and a day's counts are final once the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.counts import dimension_pairs
from murmur.operators.common import resolve_dimensions


def stream_daily_counts(stream: DataFrame, dimensions=None, lateness: str = "2 days",
                        include_total: bool = True) -> DataFrame:
    """Streaming (dimension, dimension_key, day, n) from a stream of complaint rows."""
    dims = resolve_dimensions(dimensions)
    # watermarks need an instant (TIMESTAMP); the wall clock of the NTZ open time
    # is taken as UTC, so one-day windows are exactly the NTZ calendar days
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              F.col("sr_open_dttm"))
    timed = stream.withColumn("_event", F.timestamp_micros(micros))
    deduped = timed.withWatermark("_event", lateness).dropDuplicatesWithinWatermark(["sr_number"])
    long = deduped.select("_event", F.inline(dimension_pairs(dims, include_total)))
    day = F.date_add(F.lit("1970-01-01").cast("date"),
                     (F.unix_micros(F.col("window.start")) / 86400000000).cast("int"))
    return (long.groupBy(F.window("_event", "1 day"), "dimension", "dimension_key")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("dimension", "dimension_key", day.alias("day"), "n"))

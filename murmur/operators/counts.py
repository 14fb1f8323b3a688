"""The one intermediate everything numeric derives from: counts per (dimension, key, day).

One scan produces all dimensions at once: each complaint row is fanned out to
one (dimension, key) pair per dimension inside the scan stage, and the partial
(map-side) aggregation collapses the fan-out before the shuffle, so the
shuffle carries at most (#keys x #days) rows per task regardless of how
skewed a key is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.constants import TOTAL
from murmur.operators.common import DateLike, date_scope, resolve_dimensions


def dimension_pairs(dimensions: dict[str, str], include_total: bool = False):
    items = [F.struct(F.lit(name).alias("dimension"), F.col(col).cast("string").alias("dimension_key"))
             for name, col in dimensions.items()]
    if include_total:
        items.append(F.struct(F.lit(TOTAL).alias("dimension"), F.lit(TOTAL).alias("dimension_key")))
    return F.array(*items)


def long_form(complaints: DataFrame, dimensions: Iterable[str] | dict | None = None,
              include_total: bool = False, keep: Iterable[str] = ()) -> DataFrame:
    """complaint rows -> (day, dimension, dimension_key, *keep), one row per dimension."""
    dims = resolve_dimensions(dimensions)
    return complaints.select(
        F.col("sr_open_dt").alias("day"), *keep,
        F.inline(dimension_pairs(dims, include_total)),
    )


def daily_counts(complaints: DataFrame, dimensions: Iterable[str] | dict | None = None,
                 include_total: bool = False, start: DateLike = None, end: DateLike = None,
                 lookback_days: int = 0) -> DataFrame:
    """(dimension, dimension_key, day, n) for every dimension in one pass.

    Null keys are kept as their own group (``dimension_key`` null); each
    operator decides what a null key means.
    """
    scoped = date_scope(complaints, start, end, lookback_days)
    return (long_form(scoped, dimensions, include_total)
            .groupBy("dimension", "dimension_key", "day")
            .agg(F.count(F.lit(1)).alias("n")))


def current_counts(counts: DataFrame, target_date: DateLike) -> DataFrame:
    """Counts per key on one target date."""
    return counts.filter(F.col("day") == F.lit(str(target_date)).cast("date"))


def count_changes(images: DataFrame, weight: str, dimensions: Iterable[str] | dict | None = None) -> DataFrame:
    """Change of ``daily_counts`` (with totals) by rows weighted +1 (after) and -1 (before)."""
    return (long_form(images, dimensions, include_total=True, keep=[weight])
            .groupBy("dimension", "dimension_key", "day").agg(F.sum(weight).cast("bigint").alias("n"))
            .filter(F.col("n") != 0))

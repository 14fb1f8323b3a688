"""Small shared pieces: dimension selection, date scoping, safe arithmetic."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.constants import DIMENSIONS

DateLike = str | _dt.date | Column | None


def resolve_dimensions(dimensions: Iterable[str] | dict | None = None) -> dict[str, str]:
    """Dimension name -> column.  ``None`` means all five; names keep our order."""
    if dimensions is None:
        return dict(DIMENSIONS)
    if isinstance(dimensions, dict):
        return dict(dimensions)
    wanted = set(dimensions)
    unknown = wanted - set(DIMENSIONS) - {"Total"}
    if unknown:
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    return {k: v for k, v in DIMENSIONS.items() if k in wanted}


def lit_date(d: DateLike) -> Column:
    return d if isinstance(d, Column) else F.lit(str(d)).cast("date")


def date_scope(df: DataFrame, start: DateLike = None, end: DateLike = None,
               lookback_days: int = 0, day_col: str = "sr_open_dt") -> DataFrame:
    """Keep rows needed for target dates in [start, end] plus ``lookback_days`` of history.

    The predicate is on the (partition) date column, so Catalyst pushes it into
    the scan and prunes partitions.
    """
    if start is not None:
        df = df.filter(F.col(day_col) >= F.date_sub(lit_date(start), lookback_days))
    if end is not None:
        df = df.filter(F.col(day_col) <= lit_date(end))
    return df


def target_filter(col: str, start: DateLike = None, end: DateLike = None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(col) >= lit_date(start))
    if end is not None:
        cond = cond & (F.col(col) <= lit_date(end))
    return cond


def safe_div(num: Column, den: Column, default=None) -> Column:
    """num / den, ``default`` when den is 0 or null (never raises under ANSI)."""
    out = F.when(den != 0, num.cast("double") / den)
    return out if default is None else out.otherwise(F.lit(default).cast("double"))


def sample_std(cnt: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares.

    Counts are integers, so the sums are exact and the result is the same in
    every engine; one sample (or none) gives 0, as stored baselines do.
    """
    var = (cnt * ss - s * s) / (cnt * (cnt - 1))
    return F.when(cnt > 1, F.sqrt(F.greatest(F.lit(0.0), var))).otherwise(F.lit(0.0))

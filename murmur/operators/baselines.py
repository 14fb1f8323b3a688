"""Trailing baselines of daily counts.

For an ``as_of`` date and window ``w`` the baseline covers days
``as_of - w <= day < as_of`` (the target day is excluded) and only days that
have rows: mean, sample standard deviation (0 for fewer than two days) and the
number of days with data.

Backfill form: each daily count row is copied to the ``max(windows)`` dates it
is history for, then one equi-aggregation per (dimension, key, as_of) computes
every window with conditional aggregates.  The copy factor is bounded by the
largest window (30), and the input is the small ``daily_counts`` table, not
the raw complaints.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.constants import BASELINE_WINDOWS
from murmur.operators.common import DateLike, safe_div, sample_std, target_filter


def _window_stats(lag_col: str, n_col: str, windows: Iterable[int]):
    aggs = []
    for w in windows:
        inside = F.col(lag_col) <= w
        aggs += [
            F.count(F.when(inside, 1)).alias(f"_c{w}"),
            F.sum(F.when(inside, F.col(n_col).cast("double"))).alias(f"_s{w}"),
            F.sum(F.when(inside, F.col(n_col).cast("double") * F.col(n_col))).alias(f"_ss{w}"),
        ]
    return aggs


def _finish(df: DataFrame, windows: Iterable[int], keep: list[str]) -> DataFrame:
    cols = list(keep)
    for w in windows:
        c, s, ss = F.col(f"_c{w}"), F.coalesce(F.col(f"_s{w}"), F.lit(0.0)), F.coalesce(F.col(f"_ss{w}"), F.lit(0.0))
        cols += [
            safe_div(s, c, 0.0).alias(f"avg_{w}d"),
            sample_std(c, s, ss).alias(f"std_{w}d"),
            c.alias(f"samples_{w}d"),
        ]
    return df.select(*cols)


def daily_baselines(counts: DataFrame, windows: Iterable[int] = BASELINE_WINDOWS,
                    start: DateLike = None, end: DateLike = None,
                    targets: DataFrame | None = None) -> DataFrame:
    """(dimension, dimension_key, as_of, avg_Wd, std_Wd, samples_Wd for each W).

    ``targets`` (column ``as_of``) selects the baseline dates; by default every
    date of [start, end] if both are given, else every date that has complaint
    rows within them.  A key gets a row
    for an ``as_of`` when it has at least one day of history in the largest
    window; windows without data are 0, as a full outer merge would fill them.
    """
    windows = sorted(set(windows))
    maxw = windows[-1]
    exploded = (counts
                .select("dimension", "dimension_key", "day", "n",
                        F.explode(F.sequence(F.lit(1), F.lit(maxw))).alias("lag"))
                .withColumn("as_of", F.date_add("day", F.col("lag")))
                .filter(target_filter("as_of", start, end)))
    if targets is None and (start is None or end is None):
        targets = counts.select(F.col("day").alias("as_of")).distinct()
    if targets is not None:
        exploded = exploded.join(targets.filter(target_filter("as_of", start, end)), "as_of", "left_semi")
    grouped = exploded.groupBy("dimension", "dimension_key", "as_of").agg(*_window_stats("lag", "n", windows))
    return _finish(grouped, windows, ["dimension", "dimension_key", "as_of"])


def trailing_stats(counts: DataFrame, window: int = 30) -> DataFrame:
    """Baseline of ``window`` days evaluated at each (dimension, key, day) row.

    A range frame over the day number of each key's series: one shuffle by
    (dimension, key), a sort, and a sliding aggregate.  Each partition of the
    window holds one key's days, so no key can be skewed beyond its number of
    days.
    """
    w = (Window.partitionBy("dimension", "dimension_key")
         .orderBy(F.unix_date("day")).rangeBetween(-window, -1))
    n = F.col("n").cast("double")
    c, s, ss = F.count(n).over(w), F.sum(n).over(w), F.sum(n * n).over(w)
    return counts.select(
        "*",
        c.alias("_c"), F.coalesce(s, F.lit(0.0)).alias("_s"), F.coalesce(ss, F.lit(0.0)).alias("_ss"),
    ).select(
        "dimension", "dimension_key", "day", "n",
        safe_div(F.col("_s"), F.col("_c"), 0.0).alias(f"avg_{window}d"),
        sample_std(F.col("_c"), F.col("_s"), F.col("_ss")).alias(f"std_{window}d"),
        F.col("_c").alias(f"samples_{window}d"),
    )

"""Historic drill-down series: Total > region > exchange > city, plus sub-type and rca.

All six series of the trend view come from one scan and one GROUPING SETS
aggregation over [t - days_back, t]; null keys are excluded per level.  The
nested form keeps one row per key (its sorted points), so no group grows
beyond ``days_back + 1`` points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.constants import TREND_PLOT_DAYS
from murmur.operators.common import DateLike, lit_date

PLOT_LEVELS = {
    # level: grouping columns (besides day)
    "total": [],
    "region": ["region"],
    "exchange": ["region", "exc_id"],
    "city": ["region", "exc_id", "city"],
    "subtype": ["sr_sub_type"],
    "rca": ["rca"],
}
_COLS = ["region", "exc_id", "city", "sr_sub_type", "rca"]


def _window(complaints: DataFrame, end: DateLike, days_back: int) -> DataFrame:
    t = complaints.agg(F.max("sr_open_dt")).scalar() if end is None else lit_date(end)
    return complaints.filter((F.col("sr_open_dt") >= F.date_sub(t, days_back)) & (F.col("sr_open_dt") <= t))


def trend_series(complaints: DataFrame, end: DateLike = None, days_back: int = TREND_PLOT_DAYS) -> DataFrame:
    """(level, region, exc_id, city, sr_sub_type, rca, date, count), long form.

    ``end`` defaults to the last date with complaints.
    """
    src = _window(complaints, end, days_back).select(F.col("sr_open_dt").alias("date"), *_COLS)
    sets = [[F.col("date")] + [F.col(c) for c in cols] for cols in PLOT_LEVELS.values()]
    g = src.groupingSets(sets, "date", *_COLS).agg(F.count(F.lit(1)).alias("count"),
                                                    F.grouping_id().alias("_gid"))
    label, keep = None, F.lit(False)
    for name, cols in PLOT_LEVELS.items():
        gid = sum(1 << (len(_COLS) - 1 - i) for i, c in enumerate(_COLS) if c not in cols)
        is_level = F.col("_gid") == gid
        label = F.when(is_level, name) if label is None else label.when(is_level, name)
        ok = is_level
        for c in cols:
            ok = ok & F.col(c).isNotNull()
        keep = keep | ok
    return g.filter(keep).select(label.alias("level"), *_COLS, "date", "count")


def total_trend(series: DataFrame) -> DataFrame:
    return series.filter(F.col("level") == "total").select("date", "count").orderBy("date")


def level_trend(series: DataFrame, level: str) -> DataFrame:
    cols = PLOT_LEVELS[level]
    return series.filter(F.col("level") == level).select(*cols, "date", "count").orderBy("date", *cols)


def trend_drilldown(series: DataFrame) -> DataFrame:
    """Nested form: one row per (level, key path) with its points sorted by date."""
    pts = F.array_sort(F.collect_list(F.struct(F.col("date"), F.col("count"))))
    return series.groupBy("level", *_COLS).agg(pts.alias("points"))


def trend_wide(series: DataFrame, level: str = "region", keys: list[str] | None = None) -> DataFrame:
    """Keys of one single-column level as columns (pivot), one row per date, gaps 0.

    Pass ``keys`` to fix the output columns; otherwise the distinct keys are
    looked up first (one small aggregation).
    """
    col = PLOT_LEVELS[level][-1]
    s = series.filter(F.col("level") == level)
    p = s.groupBy("date").pivot(col, keys) if keys is not None else s.groupBy("date").pivot(col)
    return p.agg(F.sum("count")).na.fill(0)


def trend_stats(series: DataFrame) -> DataFrame:
    """Mean / max / min of the daily totals."""
    t = series.filter(F.col("level") == "total")
    return t.agg(F.avg("count").alias("mean_daily"), F.max("count").alias("max_daily"),
                 F.min("count").alias("min_daily"), F.count(F.lit(1)).alias("days"))


def key_totals(series: DataFrame, level: str = "subtype") -> DataFrame:
    """Total per key of a single-column level, largest first."""
    col = PLOT_LEVELS[level][-1]
    return series.filter(F.col("level") == level).groupBy(col).agg(F.sum("count").alias("total")) \
        .orderBy(F.desc("total"), col)

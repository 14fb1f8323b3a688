"""Resolution time (MTTR) and ageing of the open backlog.

MTTR for date d: complaints closed on d whose duration is at least 300 s
(negative durations drop too); mean hours (2 digits) and count for Total/All
and per Region, City, Exchange (null or empty keys skipped).

Ageing for date d: the open backlog (opened on or before d, not closed by
d 23:59:59, status other than 'Closed'; a null status is excluded) by age
slab at d 23:59:59, for Total/All and the three dimensions; 'Within 24 Hours'
is not reported.

Backfill of ageing never expands a complaint to every day it stays open, nor
to its slabs.  A complaint's age grows by 24 h per day, so all that its slabs
depend on are three day numbers: when its age passes full days, when it is
first reported and when it leaves the backlog.  Complaints are counted by
(dimension, key, these three) map-side; only the distinct combinations are
spread over slabs, as weighted differences (+n where a slab begins, -n where
it ends) whose running sum is the count, which is then spread over the dates
between consecutive differences.  With a date range, older days are moved to
its edge first, so the number of combinations depends on the range and not on
the history.

``resolved_rows`` is the projection that MTTR needs, keyed by close date: kept
as a table partitioned by that date (``murmur.plans.incremental``), one day's
MTTR reads one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.constants import AGE_SLABS, MTTR_MIN_SECONDS, RESOLUTION_DIMENSIONS, SLAB_ORDER, WITHIN_24_HOURS
from murmur.functions.stats import round_half_up
from murmur.operators.common import DateLike, lit_date, target_filter

MTTR_COLUMNS = ["date", "dimension", "dimension_key", "avg_mttr_hours", "total_resolved_count"]
AGING_COLUMNS = ["date", "dimension", "dimension_key", "slab", "count"]
BACKLOG_KEYS = ["dimension", "dimension_key", "zero_day", "first_day", "exit_day"]
DAY = 86400
OLDEST_DAYS = max(hours for _, hours in AGE_SLABS) // 24       # every slab begins at full days


def _dim_pairs(include_total: bool = True) -> Column:
    items = [F.struct(F.lit("Total").alias("dimension"), F.lit("All").alias("dimension_key"))] \
        if include_total else []
    items += [F.struct(F.lit(name).alias("dimension"), F.col(col).cast("string").alias("dimension_key"))
              for name, col in RESOLUTION_DIMENSIONS.items()]
    return F.array(*items)


def _valid_key() -> Column:
    return F.col("dimension_key").isNotNull() & (F.col("dimension_key") != "")


def _day_start(day: Column) -> Column:
    return day.cast("date").cast("timestamp_ntz")


def resolved_rows(complaints: DataFrame, start: DateLike = None, end: DateLike = None, keep: tuple = ()) -> DataFrame:
    """(sr_number, close_dt, secs, region, city, exc_id) of the complaints closed in [start, end].

    The bounds are predicates on ``sr_close_dttm`` itself, so they reach the scan.
    """
    close = F.col("sr_close_dttm")
    closed = complaints.filter(close.isNotNull())
    if start is not None:
        closed = closed.filter(close >= _day_start(lit_date(start)))
    if end is not None:
        closed = closed.filter(close < _day_start(F.date_add(lit_date(end), 1)))
    return closed.select("sr_number", F.to_date(close).alias("close_dt"),
                         F.timestamp_diff("SECOND", F.col("sr_open_dttm"), close).alias("secs"),
                         "region", "city", "exc_id", *keep)


def mttr_from_resolved(resolved: DataFrame, start: DateLike = None, end: DateLike = None,
                       min_seconds: int = MTTR_MIN_SECONDS) -> DataFrame:
    """MTTR for every close date in [start, end] from (stored) ``resolved_rows``."""
    rows = resolved.filter(target_filter("close_dt", start, end) & (F.col("secs") >= min_seconds))
    long = rows.select(F.col("close_dt").alias("date"), "secs", F.inline(_dim_pairs())).filter(_valid_key())
    g = long.groupBy("date", "dimension", "dimension_key").agg(
        F.sum("secs").alias("_s"), F.count(F.lit(1)).alias("total_resolved_count"))
    return g.select("date", "dimension", "dimension_key",
                    round_half_up(F.col("_s") / F.col("total_resolved_count") / 3600.0, 2).alias("avg_mttr_hours"),
                    "total_resolved_count")


def mttr(complaints: DataFrame, start: DateLike = None, end: DateLike = None,
         min_seconds: int = MTTR_MIN_SECONDS) -> DataFrame:
    """MTTR for every close date in [start, end] (backfill form)."""
    return mttr_from_resolved(resolved_rows(complaints.withColumn("sr_number", F.lit(None)), start, end),
                              None, None, min_seconds)


def age_slab(age_hours: Column) -> Column:
    """Slab label of an age in hours (strict >, largest first): a native CASE, no UDF."""
    out = None
    for label, hours in AGE_SLABS:
        out = F.when(age_hours > hours, label) if out is None else out.when(age_hours > hours, label)
    return out.otherwise(WITHIN_24_HOURS)


def slab_rank(slab: Column) -> Column:
    """Presentation order of a slab label (0 = '> 24 Hours')."""
    return F.array_position(F.array(*[F.lit(s) for s in SLAB_ORDER]), slab).cast("int") - 1


def open_backlog(complaints: DataFrame, date: DateLike) -> DataFrame:
    d = lit_date(date)
    ref = F.timestamp_add("SECOND", F.lit(DAY - 1), d.cast("timestamp_ntz"))
    return complaints.filter(
        (F.col("sr_open_dt") <= d)
        & (F.col("sr_close_dttm").isNull() | (F.col("sr_close_dttm") > ref))
        & (F.col("sr_status") != "Closed")
    ).withColumn("age_hours", F.timestamp_diff("SECOND", F.col("sr_open_dttm"), ref) / 3600.0)


def aging(complaints: DataFrame, date: DateLike) -> DataFrame:
    """Ageing counts for one date."""
    b = open_backlog(complaints, date).withColumn("slab", age_slab(F.col("age_hours")))
    long = b.select("slab", F.inline(_dim_pairs())).filter(_valid_key() & (F.col("slab") != WITHIN_24_HOURS))
    return long.groupBy("dimension", "dimension_key", "slab").agg(F.count(F.lit(1)).alias("count")) \
        .select(lit_date(date).alias("date"), "dimension", "dimension_key", "slab", "count")


def _day_number(ts: Column, last_second: int) -> Column:
    """Days since 1970 of ``ts``; the next day's when its time of day is past ``last_second``."""
    day = F.to_date(ts)
    limit = F.timestamp_add("SECOND", F.lit(last_second), _day_start(day))
    return F.unix_date(day) + F.when(ts > limit, 1).otherwise(0)


def _clip(days: DataFrame, lo: Column | None, hi: Column | None) -> DataFrame:
    """Day combinations that matter for dates in [lo, hi], older and later days moved to its edges."""
    if lo is not None:
        days = days.withColumns({"zero_day": F.greatest(F.col("zero_day"), lo - OLDEST_DAYS),
                                 "first_day": F.greatest(F.col("first_day"), lo)})
    if hi is not None:
        days = days.filter(F.col("first_day") <= hi).withColumn("exit_day", F.least(F.col("exit_day"), hi + 1))
    return days.filter(F.col("exit_day").isNull() | (F.col("exit_day") > F.col("first_day")))


def backlog_counts(complaints: DataFrame, start: DateLike = None, end: DateLike = None,
                   weight: Column | None = None) -> DataFrame:
    """(dimension, dimension_key, zero_day, first_day, exit_day, n): the backlog by the days that decide its slabs.

    At the end of day D a complaint is more than ``D - zero_day`` times 24 h
    old (and not more than a day older); it is reported from ``first_day`` on
    and gone from ``exit_day`` on (null: never).  ``weight`` counts a row other
    than once.
    """
    close = F.col("sr_close_dttm")
    rows = complaints.filter((F.col("sr_status") != "Closed") & F.col("sr_open_dttm").isNotNull()
                             & F.col("sr_open_dt").isNotNull())
    if start is not None:
        day_end = F.timestamp_add("SECOND", F.lit(DAY - 1), _day_start(lit_date(start)))
        rows = rows.filter(close.isNull() | (close > day_end))
    if end is not None:
        rows = rows.filter(F.col("sr_open_dt") <= lit_date(end))
    zero = _day_number(F.col("sr_open_dttm"), DAY - 2)
    days = rows.select(zero.alias("zero_day"), F.greatest(F.unix_date("sr_open_dt"), zero + 1).alias("first_day"),
                       F.when(close.isNotNull(), _day_number(close, DAY - 1)).alias("exit_day"),
                       (F.lit(1) if weight is None else weight).cast("bigint").alias("n"), *RESOLUTION_DIMENSIONS.values())
    days = _clip(days, None if start is None else F.unix_date(lit_date(start)),
                 None if end is None else F.unix_date(lit_date(end)))
    long = days.select(F.inline(_dim_pairs()), "zero_day", "first_day", "exit_day", "n").filter(_valid_key())
    return long.groupBy(*BACKLOG_KEYS).agg(F.sum("n").alias("n"))


def aging_from_backlog(backlog: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Ageing counts of the dates up to ``end`` (from ``start`` on, if given) from (stored) ``backlog_counts``."""
    hi = F.unix_date(lit_date(end))
    counts = _clip(backlog, None if start is None else F.unix_date(lit_date(start)), hi)
    bounds = [(label, hours // 24) for label, hours in AGE_SLABS][::-1]
    pieces = []
    for i, (label, low) in enumerate(bounds):
        begins = F.greatest(F.col("zero_day") + low, F.col("first_day"))
        ends = F.least(F.col("zero_day") + bounds[i + 1][1], F.col("exit_day")) if i + 1 < len(bounds) else F.col("exit_day")
        pieces.append(F.struct(F.lit(label).alias("slab"), begins.alias("s"), ends.alias("e")))
    spans = counts.select("dimension", "dimension_key", "n", F.inline(F.array(*pieces))) \
        .filter(F.col("e").isNull() | (F.col("s") < F.col("e")))
    events = spans.select("dimension", "dimension_key", "slab",
                          F.inline(F.array(F.struct(F.col("s").alias("d"), F.col("n").alias("delta")),
                                           F.struct(F.col("e").alias("d"), (-F.col("n")).alias("delta")))))
    deltas = events.filter(F.col("d").isNotNull()).groupBy("dimension", "dimension_key", "slab", "d") \
        .agg(F.sum("delta").alias("delta")).filter(F.col("delta") != 0)
    w = Window.partitionBy("dimension", "dimension_key", "slab").orderBy("d")
    seg = deltas.select("*", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("count"),
                        F.lead("d").over(w).alias("next_d")) \
        .filter((F.col("count") != 0) & (F.col("d") <= hi))
    days = seg.select("dimension", "dimension_key", "slab", "count",
                      F.explode(F.sequence(F.col("d"), F.least(F.col("next_d") - 1, hi))).alias("dn"))
    return days.select(F.date_from_unix_date("dn").alias("date"), "dimension", "dimension_key", "slab",
                       F.col("count").cast("bigint").alias("count"))


def aging_backfill(complaints: DataFrame, start: DateLike = None, end: DateLike = None,
                   weight: Column | None = None) -> DataFrame:
    """Ageing counts for every calendar date in [start, end].

    Default range: the first to the last open date of the data (a scalar
    subquery, no driver round trip).  With a ``weight`` column of +1 and -1
    (rows after and before a change) the result is the change of the counts.
    """
    last = complaints.agg(F.max("sr_open_dt")).scalar() if end is None else end
    return aging_from_backlog(backlog_counts(complaints, start, end, weight), start, last)


def resolution_kpis(mttr_df: DataFrame, aging_df: DataFrame) -> DataFrame:
    """Per date: overall MTTR, resolved count, open backlog total, backlog > 10 days."""
    m = mttr_df.filter(F.col("dimension") == "Total").select(
        "date", F.col("avg_mttr_hours").alias("overall_mttr_hours"),
        F.col("total_resolved_count").alias("resolved_count"))
    a = aging_df.filter(F.col("dimension") == "Total").groupBy("date").agg(
        F.sum("count").alias("open_backlog"),
        F.sum(F.when(F.col("slab").isin("> 10 Days", "> 30 Days", "> 60 Days"), F.col("count"))
              .otherwise(0)).alias("backlog_over_10_days"))
    return m.join(a, "date", "full_outer")


def mttr_trend(mttr_df: DataFrame, end: DateLike, days: int = 30) -> DataFrame:
    """Total MTTR per day for the ``days`` days up to ``end``."""
    e = lit_date(end)
    return mttr_df.filter((F.col("dimension") == "Total") & (F.col("date") > F.date_sub(e, days))
                          & (F.col("date") <= e)).orderBy("date")


def mttr_breakdown(mttr_df: DataFrame, dimension: str) -> DataFrame:
    return mttr_df.filter(F.col("dimension") == dimension) \
        .orderBy("date", F.desc("avg_mttr_hours"), "dimension_key")

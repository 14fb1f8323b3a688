"""Hierarchical surge detection: Total > region > exchange > city.

For target date t and each group present on t: compare the day's count with
the month-to-date average (rows from the 1st to t - 1 divided by the number of
calendar days, 0 on the 1st: absent days count as zero here) and with the
count on t - 7.  percent = (c - p) / p * 100 to one digit; p = 0 gives 999.9
(increase = c) when c > 0.  The larger percent decides: >= alarming (20)
gives ALARMING, >= critical (50) CRITICAL.  Volume gates skip regions under
15, exchanges under 10, cities under 5 rows on t; Total is never skipped.
Null keys are excluded per level.

Plan: one scan, one grouping-sets aggregation (day x 4 levels) with partial
aggregation before the shuffle, then window frames over each group's daily
series (week-ago value as a range frame [-7, -7], month-to-date as a running
sum inside the month).  A group's series has one row per day, so the windows
cannot skew; the month-partitioned window reuses the group partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.constants import SURGE_ALARMING, SURGE_CRITICAL, SURGE_INFINITE, SURGE_MIN_VOLUME
from murmur.functions.stats import round_half_up
from murmur.operators.common import DateLike, date_scope, target_filter

SURGE_COLUMNS = ["surge_date", "level", "region", "exc_id", "city", "name", "parent", "current_count",
                 "mtd_avg", "last_week_count", "mtd_surge_percent", "mtd_surge_increase",
                 "wow_surge_percent", "wow_surge_increase", "max_surge_percent", "severity"]
LEVELS = ["Total", "Region", "Exchange", "City"]


def level_counts(complaints: DataFrame) -> DataFrame:
    """(level, region, exc_id, city, day, n) for the four hierarchy levels.

    GROUPING SETS ((day), (day, region), (day, region, exc_id), (day, region,
    exc_id, city)); a level's groups whose own keys are null are dropped.
    """
    src = complaints.select(F.col("sr_open_dt").alias("day"), "region", "exc_id", "city")
    g = src.groupingSets(
        [[F.col("day")], [F.col("day"), F.col("region")], [F.col("day"), F.col("region"), F.col("exc_id")],
         [F.col("day"), F.col("region"), F.col("exc_id"), F.col("city")]],
        "day", "region", "exc_id", "city",
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    level = (F.when(F.col("_gid") == 7, "Total").when(F.col("_gid") == 3, "Region")
             .when(F.col("_gid") == 1, "Exchange").otherwise("City"))
    g = g.withColumn("level", level)
    keep = ((F.col("level") == "Total")
            | ((F.col("level") == "Region") & F.col("region").isNotNull())
            | ((F.col("level") == "Exchange") & F.col("region").isNotNull() & F.col("exc_id").isNotNull())
            | ((F.col("level") == "City") & F.col("region").isNotNull() & F.col("exc_id").isNotNull()
               & F.col("city").isNotNull()))
    return g.filter(keep).select("level", "region", "exc_id", "city", "day", "n")


def surge_percent(cur, comp):
    """(percent, increase) of ``cur`` against ``comp``."""
    pct = (F.when(comp == 0, F.when(cur > 0, F.lit(SURGE_INFINITE)).otherwise(F.lit(0.0)))
           .otherwise(round_half_up((cur - comp) / comp * 100.0, 1)))
    inc = (F.when(comp == 0, F.when(cur > 0, cur.cast("double")).otherwise(F.lit(0.0)))
           .otherwise(round_half_up(cur - comp, 1)))
    return pct, inc


def surges_from_levels(levels: DataFrame, start: DateLike = None, end: DateLike = None,
                       alarming: float = SURGE_ALARMING, critical: float = SURGE_CRITICAL,
                       min_volume: dict | None = None) -> DataFrame:
    gates = dict(SURGE_MIN_VOLUME if min_volume is None else min_volume)
    grp = ["level", "region", "exc_id", "city"]
    day_no = F.unix_date("day")
    week_ago = Window.partitionBy(*grp).orderBy(day_no).rangeBetween(-7, -7)
    mtd = Window.partitionBy(*grp, F.trunc("day", "month")).orderBy(day_no) \
        .rowsBetween(Window.unboundedPreceding, -1)
    s = levels.select(
        *grp, "day", "n",
        F.coalesce(F.sum("n").over(week_ago), F.lit(0)).alias("last_week_count"),
        F.coalesce(F.sum("n").over(mtd), F.lit(0)).alias("_mtd_sum"),
    ).filter(target_filter("day", start, end))
    gate = F.lit(0)
    for lvl, v in gates.items():
        gate = F.when(F.col("level") == lvl, F.lit(v)).otherwise(gate)
    s = s.filter(F.col("n") >= gate)
    days = F.dayofmonth("day") - 1
    mtd_avg = F.when(days > 0, F.col("_mtd_sum") / days).otherwise(F.lit(0.0))
    s = s.withColumn("_mtd_avg", mtd_avg)
    cur = F.col("n")
    mtd_pct, mtd_inc = surge_percent(cur, F.col("_mtd_avg"))
    wow_pct, wow_inc = surge_percent(cur, F.col("last_week_count"))
    s = s.select("*", mtd_pct.alias("mtd_surge_percent"), mtd_inc.alias("mtd_surge_increase"),
                 wow_pct.alias("wow_surge_percent"), wow_inc.alias("wow_surge_increase"))
    s = s.withColumn("max_surge_percent", F.greatest("mtd_surge_percent", "wow_surge_percent")) \
         .filter(F.col("max_surge_percent") >= alarming)
    name = (F.when(F.col("level") == "Total", F.lit("Total")).when(F.col("level") == "Region", F.col("region"))
            .when(F.col("level") == "Exchange", F.col("exc_id")).otherwise(F.col("city")))
    parent = (F.when(F.col("level") == "Exchange", F.col("region"))
              .when(F.col("level") == "City", F.concat_ws(" > ", "region", "exc_id")))
    return s.select(
        F.col("day").alias("surge_date"), *grp, name.alias("name"), parent.alias("parent"),
        F.col("n").alias("current_count"), round_half_up(F.col("_mtd_avg"), 1).alias("mtd_avg"),
        F.col("last_week_count").cast("bigint").alias("last_week_count"),
        "mtd_surge_percent", "mtd_surge_increase", "wow_surge_percent", "wow_surge_increase",
        "max_surge_percent",
        F.when(F.col("max_surge_percent") >= critical, "CRITICAL").otherwise("ALARMING").alias("severity"),
    )


def daily_surges(complaints: DataFrame, start: DateLike = None, end: DateLike = None,
                 alarming: float = SURGE_ALARMING, critical: float = SURGE_CRITICAL,
                 min_volume: dict | None = None) -> DataFrame:
    """Surges for target dates in [start, end]; scans from one month before start."""
    scoped = date_scope(complaints, start, end, lookback_days=31)
    return surges_from_levels(level_counts(scoped), start, end, alarming, critical, min_volume)


def surge_summary(surges: DataFrame) -> DataFrame:
    """Count of surges per date and severity."""
    return surges.groupBy("surge_date", "severity").agg(F.count(F.lit(1)).alias("surge_count"))


def surge_table(surges: DataFrame) -> DataFrame:
    """All levels in presentation order: CRITICAL first, then largest percent."""
    return surges.withColumn("_sev", F.when(F.col("severity") == "CRITICAL", 0).otherwise(1)) \
        .orderBy("surge_date", "_sev", F.desc("max_surge_percent"), "level", "name").drop("_sev")

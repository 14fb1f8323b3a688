"""Repeat complainers: the same ``mdn`` more than once in the 30 days to a target date.

Per mdn (non-null, non-empty) over [t - 30, t]: number of complaints, a
representative region / exchange / city (the earliest complaint, by open time
then sr_number) and the most frequent sub-type (the smallest value among tied
modes, nulls ignored).  Severity: > 10 VERY ALARMING, > 6 CRITICAL,
> 3 ALARMING, else NORMAL REPEAT.

All aggregates (count, min_by, mode) combine partially before the shuffle by
mdn, so a single mdn holding a large share of the rows is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.constants import (REPEAT_ALARMING, REPEAT_CRITICAL, REPEAT_HISTORY_DAYS, REPEAT_TOP,
                              REPEAT_VERY_ALARMING)
from murmur.operators.common import DateLike, lit_date

REPEATER_COLUMNS = ["target_date", "mdn", "repeat_count", "region", "exc_id", "city", "sr_sub_type", "severity"]


def repeat_severity(count):
    return (F.when(count > REPEAT_VERY_ALARMING, "VERY ALARMING")
            .when(count > REPEAT_CRITICAL, "CRITICAL")
            .when(count > REPEAT_ALARMING, "ALARMING")
            .otherwise("NORMAL REPEAT"))


def repeat_complainers(complaints: DataFrame, target_date: DateLike = None,
                       history_days: int = REPEAT_HISTORY_DAYS) -> DataFrame:
    """Repeaters for ``target_date`` (default: the last date with complaints)."""
    if target_date is None:
        t = complaints.agg(F.max("sr_open_dt")).scalar()
    else:
        t = lit_date(target_date)
    rows = complaints.filter(
        (F.col("sr_open_dt") >= F.date_sub(t, history_days)) & (F.col("sr_open_dt") <= t)
        & F.col("mdn").isNotNull() & (F.col("mdn") != ""))
    first_key = F.struct("sr_open_dttm", "sr_number")
    g = rows.groupBy("mdn").agg(
        F.count(F.lit(1)).alias("repeat_count"),
        F.min_by(F.struct("region", "exc_id", "city"), first_key).alias("_rep"),
        F.mode("sr_sub_type", True).alias("sr_sub_type"),
    ).filter(F.col("repeat_count") > 1)
    return g.select(
        t.alias("target_date"), "mdn", "repeat_count",
        F.col("_rep.region").alias("region"), F.col("_rep.exc_id").alias("exc_id"),
        F.col("_rep.city").alias("city"), "sr_sub_type",
        repeat_severity(F.col("repeat_count")).alias("severity"),
    )


_BREAKDOWNS = [
    ("region", ["region"]),
    ("region_subtype", ["region", "sr_sub_type"]),
    ("exchange", ["exc_id"]),
    ("exchange_subtype", ["exc_id", "sr_sub_type"]),
    ("city", ["city"]),
    ("city_subtype", ["city", "sr_sub_type"]),
    ("severity", ["severity"]),
    ("subtype", ["sr_sub_type"]),
]
_BREAKDOWN_COLS = ["region", "exc_id", "city", "sr_sub_type", "severity"]


def repeat_summaries(repeaters: DataFrame) -> DataFrame:
    """The eight breakdowns as one GROUPING SETS aggregation, long form.

    (breakdown, region, exc_id, city, sr_sub_type, severity, repeater_count);
    columns not part of a breakdown are null, null keys are kept as groups.
    """
    sets = [[F.col(c) for c in cols] for _, cols in _BREAKDOWNS]
    g = repeaters.groupingSets(sets, *_BREAKDOWN_COLS).agg(
        F.count(F.lit(1)).alias("repeater_count"), F.grouping_id().alias("_gid"))
    label = None
    for name, cols in _BREAKDOWNS:
        gid = sum(1 << (len(_BREAKDOWN_COLS) - 1 - i) for i, c in enumerate(_BREAKDOWN_COLS) if c not in cols)
        label = F.when(F.col("_gid") == gid, name) if label is None else label.when(F.col("_gid") == gid, name)
    return g.select(label.alias("breakdown"), *_BREAKDOWN_COLS, "repeater_count")


def top_repeaters(repeaters: DataFrame, n: int = REPEAT_TOP) -> DataFrame:
    """The ``n`` highest counts (ties by mdn): a top-k, planned as TakeOrderedAndProject."""
    return repeaters.orderBy(F.desc("repeat_count"), "mdn").limit(n)


def repeat_kpis(repeaters: DataFrame) -> DataFrame:
    """One row: repeaters, critical (CRITICAL + VERY ALARMING), per severity, top sub-type."""
    sev = F.col("severity")
    return repeaters.agg(
        F.count(F.lit(1)).alias("total_repeaters"),
        F.count(F.when(sev.isin("CRITICAL", "VERY ALARMING"), 1)).alias("critical_repeaters"),
        F.count(F.when(sev == "VERY ALARMING", 1)).alias("very_alarming"),
        F.count(F.when(sev == "CRITICAL", 1)).alias("critical"),
        F.count(F.when(sev == "ALARMING", 1)).alias("alarming"),
        F.count(F.when(sev == "NORMAL REPEAT", 1)).alias("normal_repeat"),
        F.mode("sr_sub_type", True).alias("top_sub_type"),
    )


# rows shown of each breakdown, largest first
_SHOWN = {"exchange": 10, "city": 10, "subtype": 10, "region_subtype": 20, "exchange_subtype": 20, "city_subtype": 20}


def top_breakdowns(summaries: DataFrame, shown: dict[str, int] | None = None) -> DataFrame:
    """The largest rows of each breakdown of ``repeat_summaries`` with their ``rank``; ties by the keys, nulls first."""
    limits = _SHOWN if shown is None else shown
    keys = [F.asc_nulls_first(c) for c in _BREAKDOWN_COLS]
    w = Window.partitionBy("breakdown").orderBy(F.desc("repeater_count"), *keys)
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return summaries.filter(F.col("breakdown").isin(*limits)).withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= F.try_element_at(most, F.col("breakdown")))

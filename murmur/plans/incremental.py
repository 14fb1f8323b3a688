"""Batches of changed complaints, carried through to every table that depends on them.

``apply_batch`` upserts a batch and corrects four stored projections of the
complaints by its before and after images (-old +new): daily counts, root
cause counts, complaints by close date, and the backlog by the days that
decide its slabs.  Reads are bounded by the batch: the partitions that hold
its keys, and the projections' partitions of its days.  All new partitions
are staged first, then one journal entry names them, then they are moved in;
``finish_batch`` (also run by the next batch) completes moves that were
interrupted.  Before the entry nothing has changed, after it everything
will: a batch is applied once, whatever is lost on the way.

``refresh_results`` recomputes the result tables from the projections, only
for target dates that the images can reach (a changed day moves baselines for
30 days, severities for one more, month-over-month variations for 62), and
can be repeated at will.  Validation issues and repeat complainers need the
complaints themselves and are left to ``run_daily``.

One writer at a time is assumed.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.constants import CORRELATION_HISTORY_DAYS, TREND_WINDOWS
from murmur.operators.anomalies import anomalies_from_counts
from murmur.operators.common import resolve_dimensions
from murmur.operators.counts import count_changes
from murmur.operators.enrich import daily_rca_counts, enrich_anomalies, narrate
from murmur.operators.resolution import (BACKLOG_KEYS, aging_backfill, aging_from_backlog, backlog_counts,
                                         mttr_from_resolved, resolved_rows)
from murmur.operators.trends import trends_from_counts
from murmur.operators.variations import HORIZON_DAYS, variations_from_counts
from murmur.sources.sinks import (WEIGHT, delete_path, path_exists, prepare_upsert, read_text, replace_by_date,
                                  stage_partitions, swap_staged, write_text)

# projection -> (its rows as changes of a batch's images, its partition column)
PROJECTIONS = {
    "counts": (lambda images: count_changes(images, WEIGHT), "day"),
    "rca_counts": (lambda images: daily_rca_counts(images, weight=F.col(WEIGHT)), "day"),
    "resolved": (lambda images: resolved_rows(images, keep=(F.col(WEIGHT).cast("bigint").alias("n"),)), "close_dt"),
    "backlog": (lambda images: backlog_counts(images, weight=F.col(WEIGHT)), "first_day"),
}
# days after a changed day that a result table's rows can change on
REACH = {"daily_anomalies": CORRELATION_HISTORY_DAYS + 1, "daily_trends": max(TREND_WINDOWS), "daily_variations": HORIZON_DAYS}


def _stage_corrected(spark: SparkSession, table: str, changes: DataFrame, day_col: str) -> str:
    """Stage the partitions of ``table`` that ``changes`` (keys and a signed ``n``) touch, corrected."""
    days = [r[0] for r in changes.select(day_col).distinct().collect()]         # a row a date
    keys = [c for c in changes.columns if c != "n"]
    rows = changes
    if path_exists(spark, table):
        rows = spark.read.parquet(table).filter(F.col(day_col).isin(*days)).select(*changes.columns).unionByName(changes)
    corrected = rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)
    return stage_partitions(spark, corrected, table, [day_col], {f"{day_col}={d}" for d in days if d is not None})


def finish_batch(spark: SparkSession, root: str) -> None:
    """Complete the moves of a batch that was decided but not finished."""
    journal = f"{root}/_journal"
    if path_exists(spark, journal):
        for name, staged in json.loads(read_text(spark, journal)).items():
            swap_staged(spark, staged, f"{root}/{name}")
        delete_path(spark, journal)


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, supplied: list[str],
                projections: tuple = tuple(PROJECTIONS)) -> dict:
    """Upsert ``batch`` into ``root/complaints`` and correct the projections beside it.

    Returns the counts of inserted and updated keys and the folder of the
    batch's images (kept, for ``refresh_results``).
    """
    finish_batch(spark, root)
    path = f"{root}/_images/{uuid.uuid4().hex}"
    staged, report = prepare_upsert(spark, f"{root}/complaints", batch, supplied, images=path)
    folders, images = {"complaints": staged}, spark.read.parquet(path)
    for name in projections:
        changes_of, day_col = PROJECTIONS[name]
        folders[name] = _stage_corrected(spark, f"{root}/{name}", changes_of(images), day_col)
    # the entry appears whole or not at all: written aside, then renamed
    write_text(spark, f"{root}/_journal.new", json.dumps(folders))
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(jvm.Path(f"{root}/_journal.new"), jvm.Path(f"{root}/_journal"))
    finish_batch(spark, root)
    return report | {"images": path}


def _reached(days: set, reach: int, start: _dt.date, end: _dt.date) -> list[_dt.date]:
    return sorted({t for d in days for k in range(reach + 1) if start <= (t := d + _dt.timedelta(k)) <= end})


def refresh_results(spark: SparkSession, root: str, out_dir: str, images: str, start, end, dimensions=None) -> dict[str, list]:
    """Recompute the result tables in ``out_dir`` for the dates of [start, end] that a batch's ``images`` reach.

    Returns the dates replaced, by table; equal to ``run_daily`` over the range.
    """
    start, end = _dt.date.fromisoformat(str(start)), _dt.date.fromisoformat(str(end))
    changed = spark.read.parquet(images)
    dims = list(resolve_dimensions(dimensions))
    dates_of = lambda df, col: {r[0] for r in df.select(col).distinct().collect() if r[0] is not None}
    days = dates_of(changed, "sr_open_dt")
    dates = {name: _reached(days, reach, start, end) for name, reach in REACH.items()}
    dates["daily_mttr"] = sorted(d for d in dates_of(changed.select(F.to_date("sr_close_dttm").alias("d")), "d")
                                 if start <= d <= end)
    dates["daily_aging"] = sorted(dates_of(aging_backfill(changed, start, end, F.col(WEIGHT)), "date"))

    between = lambda col, lo, hi, back=0: F.col(col).between(F.lit(lo - _dt.timedelta(back)), F.lit(hi))
    own = {"daily_anomalies": ("anomaly_date", dims), "daily_trends": ("trend_date", dims),
           "daily_variations": ("variation_date", [*dims, "Total"]), "daily_mttr": ("date", None), "daily_aging": ("date", None)}

    def rows(name: str, lo: _dt.date, hi: _dt.date) -> DataFrame:
        if name == "daily_mttr":
            return mttr_from_resolved(spark.read.parquet(f"{root}/resolved"), lo, hi)
        if name == "daily_aging":
            return aging_from_backlog(spark.read.parquet(f"{root}/backlog").select(*BACKLOG_KEYS, "n"), lo, hi)
        counts = spark.read.parquet(f"{root}/counts").select("dimension", "dimension_key", "day", "n") \
            .filter(between("day", lo, hi, HORIZON_DAYS))
        if name == "daily_variations":
            return variations_from_counts(counts.filter(F.col("dimension").isin(*dims, "Total")), lo, hi)
        counts = counts.filter(F.col("dimension") != "Total")
        if name == "daily_trends":
            return trends_from_counts(counts.filter(F.col("dimension").isin(*dims)), start=lo, end=hi)
        before = lo - _dt.timedelta(1)                          # the first date's severity looks at the day before
        causes = spark.read.parquet(f"{root}/rca_counts").filter(between("day", before, hi))
        return enrich_anomalies(anomalies_from_counts(counts, before, hi), counts, causes) \
            .filter(F.col("dimension").isin(*dims))

    for name, (col, kept) in own.items():
        if dates[name]:
            replace_by_date(spark, rows(name, dates[name][0], dates[name][-1]), f"{out_dir}/{name}", col, dates[name], kept)
    told = dates["daily_anomalies"]
    if told and path_exists(spark, f"{out_dir}/daily_anomalies"):
        stored = spark.read.parquet(f"{out_dir}/daily_anomalies").filter(
            F.col("anomaly_date").isin(*told) & F.col("dimension").isin(*dims))
        insights = narrate(stored, with_dimension=True).withColumn("insight_date", F.to_date("created_at"))
        replace_by_date(spark, insights, f"{out_dir}/exec_insights", "insight_date", told, dims)
    return dates

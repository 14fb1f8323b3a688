"""The daily pipeline as one Spark application.

ingest (optional) -> validate -> anomalies -> trends -> variations ->
enrichment (correlation, root cause, severity, narrative) -> repeats ->
resolution, for one date or a whole range of dates.

``daily_counts`` for the range plus 62 days of history is computed once and
written to a table under the shared checkpoint folder (``spark.checkpoint.dir``),
which cuts the lineage: every result table is derived from that small table,
and a lost executor only recomputes from it, not from the raw scan.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.anomalies import anomalies_from_counts
from murmur.operators.counts import daily_counts
from murmur.operators.common import date_scope, resolve_dimensions
from murmur.operators.enrich import daily_rca_counts, enrich_anomalies, narrate
from murmur.operators.ingest import coerce_complaints, ingest_report, parse_dates
from murmur.operators.repeats import repeat_complainers
from murmur.operators.resolution import aging_backfill, mttr
from murmur.operators.trends import trends_from_counts
from murmur.operators.validate import validation_issues
from murmur.operators.variations import HORIZON_DAYS, variations_from_counts
from murmur.session import configure, scratch_table_path
from murmur.sources.csv import FILE_COLUMN, POSITION_COLUMN, read_complaints_csv
from murmur.sources.sinks import delete_path, path_exists, replace_by_date, upsert_complaints

CONTEXT_DIMENSIONS = ["Type", "Region"]


def ingest_file(spark: SparkSession, csv_path: str | list[str], table: str, rejects_path: str | None = None) -> dict:
    """Read complaint CSV files, coerce them, upsert them into ``table``; returns a report.

    Of rows with one key the last counts, by file name and place in the file.
    Rows without an open time are appended to ``rejects_path`` if it is given.
    """
    raw = read_complaints_csv(spark, csv_path, with_position=True)
    complaints, rejects, supplied = coerce_complaints(raw, keep=[FILE_COLUMN, POSITION_COLUMN])
    report = ingest_report(parse_dates_for_report(raw.drop(FILE_COLUMN, POSITION_COLUMN))).first().asDict()
    if report["rows_kept"] == 0:
        sample = rejects.select("raw_sr_open_dttm").limit(1).collect()
        raise ValueError("No valid rows after date parsing (sample raw date: "
                         f"{sample[0][0] if sample else 'N/A'!r}); check the file's date format")
    if rejects_path and report["rows_rejected"]:
        rejects.write.mode("append").parquet(rejects_path)
    report.update(upsert_complaints(spark, table, complaints, supplied))
    return report


def parse_dates_for_report(raw: DataFrame) -> DataFrame:
    from murmur.operators.ingest import (apply_synonyms, fill_missing_columns, normalize_headers,
                                         rename_priority_status)
    return parse_dates(fill_missing_columns(rename_priority_status(apply_synonyms(normalize_headers(raw)))))


def _dates(start, end) -> list[_dt.date]:
    s, e = _dt.date.fromisoformat(str(start)), _dt.date.fromisoformat(str(end))
    return [s + _dt.timedelta(days=i) for i in range((e - s).days + 1)]


def run_daily(spark: SparkSession, complaints: DataFrame, out_dir: str, start, end=None,
              dimensions=None, write: bool = True) -> dict[str, DataFrame]:
    """Compute (and, with ``write``, store by date) every result table for [start, end]."""
    configure(spark)
    end = end or start
    scoped = date_scope(complaints, start, end, lookback_days=HORIZON_DAYS)
    counts_path = scratch_table_path(spark, f"daily_counts-{uuid.uuid4().hex}")
    dims = list(resolve_dimensions(dimensions))
    # correlations and severities of any dimension look at Type and Region too
    daily_counts(scoped, [*dims, *CONTEXT_DIMENSIONS], include_total=True).write.mode("overwrite").parquet(counts_path)
    counts_all = spark.read.parquet(counts_path)
    counts = counts_all.filter(F.col("dimension") != "Total")
    asked, asked_total = F.col("dimension").isin(*dims), F.col("dimension").isin(*dims, "Total")
    # the first date's severity depends on the day before it, so that one is computed too
    before = _dates(start, start)[0] - _dt.timedelta(days=1)
    anomalies = anomalies_from_counts(counts, before, end)
    enriched = enrich_anomalies(anomalies, counts, daily_rca_counts(date_scope(complaints, before, end))).filter(
        (F.col("anomaly_date") >= F.lit(str(start)).cast("date")) & asked)
    last = F.lit(str(end)).cast("date")
    results = {
        "validation_issues": validation_issues(complaints, start, end).withColumn("validated_to", last),
        "daily_anomalies": enriched,
        "daily_trends": trends_from_counts(counts.filter(asked), start=start, end=end),
        "daily_variations": variations_from_counts(counts_all.filter(asked_total), start, end),
        "repeat_complainers": repeat_complainers(complaints, end).withColumn("as_of", last),
        "daily_mttr": mttr(complaints, start, end),
        "daily_aging": aging_backfill(complaints, start, end),
    }
    if write:
        dates = _dates(start, end)
        replaced = {"daily_anomalies": ("anomaly_date", dates), "daily_trends": ("trend_date", dates),
                    "daily_variations": ("variation_date", dates), "daily_mttr": ("date", dates),
                    "daily_aging": ("date", dates), "validation_issues": ("validated_to", dates[-1:]),
                    "repeat_complainers": ("as_of", dates[-1:])}
        own = {"daily_anomalies": dims, "daily_trends": dims, "daily_variations": [*dims, "Total"]}
        for name, (col, days) in replaced.items():
            replace_by_date(spark, results[name], f"{out_dir}/{name}", col, days, own.get(name))
        # insights are told from the stored anomalies: nothing is enriched twice
        if path_exists(spark, f"{out_dir}/daily_anomalies"):
            results["daily_anomalies"] = spark.read.schema(enriched.schema).parquet(f"{out_dir}/daily_anomalies").filter(
                F.col("anomaly_date").between(F.lit(str(start)).cast("date"), last) & F.col("dimension").isin(*dims))
        told = narrate(results["daily_anomalies"], with_dimension=True).withColumn("insight_date", F.to_date("created_at"))
        replace_by_date(spark, told, f"{out_dir}/exec_insights", "insight_date", dates, dims)
    results["exec_insights"] = narrate(results["daily_anomalies"])
    results["_counts_path"] = counts_path
    return results


def cleanup(spark: SparkSession, results: dict) -> None:
    delete_path(spark, results.get("_counts_path", ""))

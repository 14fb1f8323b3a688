"""Registered queries: ingest transforms over a complaint view written out as raw text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from murmur.constants import DATE_FORMATS, DATETIME_FORMATS
from murmur.operators.ingest import coerce_complaints, ingest_report, parse_dates
from murmur.operators.text import load_text_dedup
from murmur.plans.catalog import register
from murmur.plans.oracle import with_complaints
from murmur.session import scratch_table_path
from murmur.sources.csv import read_complaints_csv
from murmur.sources.tables import complaints, read_table

ORD = "complaints_ord"
# written by the order's number modulo 5; the fifth kind cannot be parsed
_WRITTEN = ["dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm:ss"]
_KIND_SQL = "CAST(substr(sr_number, 4) AS BIGINT) % 5"


def _raw(spark, sf_dir):
    """The order complaints as a file would give them: strings, foreign headers, several date formats."""
    c = complaints(spark, sf_dir, ORD)
    kind = F.substr("sr_number", F.lit(4)).cast("bigint") % 5
    opened = F.lit("not a date")
    for i, pattern in enumerate(_WRITTEN):
        opened = F.when(kind == i, F.date_format("sr_open_dttm", pattern)).otherwise(opened)
    return c.select(F.col("sr_number").alias("SR Number"), opened.alias("Open Date"),
                    F.col("sr_type").alias("Complaint Type"), F.col("region").alias("Zone"),
                    F.col("exc_id").alias("Exchange"), F.col("sr_status").alias("Status"))


@register("coerce_complaints", with_complaints(ORD) + f"""
SELECT sr_number, sr_open_dttm, sr_open_dt, sr_type, region, exc_id, sr_status FROM c WHERE {_KIND_SQL} <> 4""")
def q_coerce_complaints(spark, sf_dir):
    good, _, _ = coerce_complaints(_raw(spark, sf_dir))
    return good.select("sr_number", "sr_open_dttm", "sr_open_dt", "sr_type", "region", "exc_id", "sr_status")


def _written(value, formats, kind):
    """``value`` as text, in the format with the number ``kind``."""
    out = F.lit(None).cast("string")
    for i, pattern in enumerate(formats):
        out = F.when(kind == i, F.date_format(value, pattern)).otherwise(out)
    return out


def _read_back(value, kind, minutes, swapped):
    """SQL of what a written time is read as: to the minute, or with day and month swapped where both orders fit."""
    cut = f"CASE WHEN {kind} IN ({minutes}) THEN date_trunc('minute', {value}) ELSE {value} END" if minutes else value
    return f"""CASE WHEN {kind} IN ({swapped}) AND day({value}) <= 12
        THEN make_timestamp(year({value}), day({value}), month({value}), hour({value}), minute({value}),
                            CASE WHEN {kind} IN ({minutes or -1}) THEN 0 ELSE second({value}) END::DOUBLE) ELSE {cut} END"""


# by position in DATETIME_FORMATS: those to the minute; those whose text an earlier one with day and month swapped may fit
_MINUTES, _SWAPPED = "1, 2, 3, 5, 7", "3, 10, 13, 17"


@register("coerce_date_formats", with_complaints(ORD) + f"""
, k AS (SELECT *, CAST(substr(sr_number, 4) AS BIGINT) AS x FROM c),
t AS (SELECT *, {_read_back("sr_open_dttm", "x % 19", _MINUTES, _SWAPPED)} AS opened,
             {_read_back("sr_close_dttm", "(x + 7) % 19", _MINUTES, _SWAPPED)} AS closed,
             {_read_back("sr_open_dttm", "x % 7", "", "5")} AS given FROM k)
SELECT sr_number, opened AS sr_open_dttm, closed AS sr_close_dttm,
       CAST(CASE WHEN x % 7 = 6 THEN opened ELSE given END AS DATE) AS sr_open_dt FROM t""")
def q_coerce_date_formats(spark, sf_dir):
    """Every datetime format for open and close times, every date format for the given open date (the seventh is none)."""
    c = complaints(spark, sf_dir, ORD)
    n = F.substr("sr_number", F.lit(4)).cast("bigint")
    raw = c.select("sr_number", _written(F.col("sr_open_dttm"), DATETIME_FORMATS, n % 19).alias("sr_open_dttm"),
                   _written(F.col("sr_close_dttm"), DATETIME_FORMATS, (n + 7) % 19).alias("sr_close_dttm"),
                   F.coalesce(_written(F.col("sr_open_dttm"), DATE_FORMATS, n % 7), F.lit("n/a")).alias("sr_open_dt"),
                   "sr_type", "region", "exc_id")
    good, _, _ = coerce_complaints(raw)
    return good.select("sr_number", "sr_open_dttm", "sr_close_dttm", "sr_open_dt")


@register("ingest_rejects", with_complaints(ORD) + f"""
SELECT sr_number, 'not a date' AS raw_sr_open_dttm FROM c WHERE {_KIND_SQL} = 4""")
def q_ingest_rejects(spark, sf_dir):
    _, bad, _ = coerce_complaints(_raw(spark, sf_dir))
    return bad.select("sr_number", "raw_sr_open_dttm")


@register("ingest_report", with_complaints(ORD) + f"""
SELECT count(*) AS rows_read, count(*) FILTER ({_KIND_SQL} <> 4) AS rows_kept,
       count(*) FILTER ({_KIND_SQL} = 4) AS rows_rejected FROM c""")
def q_ingest_report(spark, sf_dir):
    raw = _raw(spark, sf_dir).select(F.col("SR Number").alias("sr_number"), F.col("Open Date").alias("sr_open_dttm"))
    return ingest_report(parse_dates(raw)).drop("columns_found")


@register("load_text_dedup", """
SELECT min(doc_id) AS complaint_id, text AS complaint_text FROM documents WHERE text IS NOT NULL GROUP BY text""")
def q_load_text_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("complaint_id"), "text")
    return load_text_dedup(docs)


@register("read_complaints_csv", """
SELECT CAST(doc_id AS VARCHAR) AS complaint_id, lang, source, text AS complaint_text FROM documents""")
def q_read_complaints_csv(spark, sf_dir):
    """All documents written as CSV files (quotes, separators and newlines in the texts) and read back by blocks."""
    path = scratch_table_path(spark, f"csv-{uuid.uuid4().hex}")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("complaint_id"), "lang", "source",
                                                         F.col("text").alias("complaint_text"))
    docs.write.options(header=True, escape='"', sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_complaints_csv(spark, path, split_over=0)

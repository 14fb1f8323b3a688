"""Ingestion transforms: from an all-string CSV frame to the complaint schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.constants import (COLUMN_SYNONYMS, COMPLAINT_COLUMNS, DATE_FORMATS, DATETIME_FORMATS,
                              EXPECTED_OPTIONAL_COLUMNS, REQUIRED_COLUMNS)
from murmur.functions.dates import parse_columns
from murmur.schemas import COMPLAINTS_SCHEMA


class SchemaError(ValueError):
    def __init__(self, missing, found, required):
        super().__init__(f"Schema validation failed. Missing: {missing}")
        self.diagnostics = {"missing": missing, "found": found, "required": required}


class NoValidRowsError(ValueError):
    pass


def normalize_headers(df: DataFrame) -> DataFrame:
    """lower, strip, space -> underscore (a BOM left on the first name is dropped)."""
    return df.toDF(*[str(c).lstrip("﻿").lower().strip().replace(" ", "_") for c in df.columns])


def apply_synonyms(df: DataFrame, synonyms: dict[str, list[str]] = COLUMN_SYNONYMS) -> DataFrame:
    """For each missing target, rename the first synonym present (targets and synonyms in order)."""
    for target, names in synonyms.items():
        if target in df.columns:
            continue
        for name in names:
            if name in df.columns:
                df = df.withColumnRenamed(name, target)
                break
    return df


def rename_priority_status(df: DataFrame) -> DataFrame:
    if "sr_prio_cd" in df.columns and "priority" not in df.columns:
        df = df.withColumnRenamed("sr_prio_cd", "priority")
    if "status" in df.columns and "sr_status" not in df.columns:
        df = df.withColumnRenamed("status", "sr_status")
    return df


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Raise ``SchemaError`` when a required column is absent (checked before any null-filling)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(missing, [c for c in required if c in df.columns], list(required))
    return df


def fill_missing_columns(df: DataFrame, columns: list[str] = EXPECTED_OPTIONAL_COLUMNS) -> DataFrame:
    add = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    return df.withColumns(add) if add else df


def parse_dates(df: DataFrame) -> DataFrame:
    """sr_open_dttm / sr_close_dttm by the format list, sr_open_dt by date formats or the open time."""
    parsed = {"sr_open_dttm": ("raw_sr_open_dttm", DATETIME_FORMATS)}
    if "sr_close_dttm" in df.columns:
        parsed["sr_close_dttm"] = ("sr_close_dttm", DATETIME_FORMATS)
    if "sr_open_dt" in df.columns:
        parsed["sr_open_dt"] = ("sr_open_dt", DATE_FORMATS)
    out = parse_columns(df.withColumn("raw_sr_open_dttm", F.col("sr_open_dttm").cast("string")), parsed)
    open_date = F.to_date("sr_open_dttm")
    out = out.withColumn("sr_open_dt", F.coalesce(F.to_date("sr_open_dt"), open_date) if "sr_open_dt" in df.columns else open_date)
    if "sr_duration" in out.columns:
        out = out.withColumn("sr_duration", F.col("sr_duration").cast("string"))
    return out


def reject_reason() -> Column:
    """Why a parsed row is not kept; null for rows that are."""
    return F.when(F.col("sr_open_dttm").isNull(), "open time not parsed").when(
        F.col("sr_number").isNull() | (F.trim(F.col("sr_number").cast("string")) == ""), "no sr_number")


def split_unparsed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, all others with the raw text kept and a ``reason``)."""
    marked = df.withColumn("reason", reject_reason())
    return df.filter(reject_reason().isNull()), marked.filter(F.col("reason").isNotNull())


def project_to_model(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Model columns in schema order (absent ones null) and ``keep``; rows without sr_number dropped."""
    cols = []
    for f in COMPLAINTS_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols, *(keep or [])).filter(F.col("sr_number").isNotNull() & (F.trim(F.col("sr_number")) != ""))


def supplied_columns(raw_columns: list[str]) -> list[str]:
    """Model columns that the input file actually supplied (after renames)."""
    return [c for c in COMPLAINT_COLUMNS if c in raw_columns]


def coerce_complaints(raw: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """All ingestion transforms: (complaints, rejects, supplied columns); ``keep`` passes columns through."""
    df = rename_priority_status(apply_synonyms(normalize_headers(raw)))
    require_columns(df)
    # sr_open_dt is always written: parsed from the file, or derived from the open time
    supplied = supplied_columns(df.columns + ["sr_open_dt"])
    df = parse_dates(fill_missing_columns(df))
    good, bad = split_unparsed(df)
    return project_to_model(good, keep), bad, supplied


def ingest_report(parsed: DataFrame) -> DataFrame:
    """One row from one aggregation over the parsed (not yet filtered) frame:
    rows read, kept (open time parsed and sr_number present), rejected."""
    kept = reject_reason().isNull()
    return parsed.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(kept).alias("rows_kept")).select(
        "rows_read", "rows_kept", (F.col("rows_read") - F.col("rows_kept")).alias("rows_rejected"),
        F.lit(", ".join(parsed.columns)).alias("columns_found"))

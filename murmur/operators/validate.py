"""Data-quality checks and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmur.functions.dates import truncate_to_hour
from murmur.operators.common import DateLike, date_scope, lit_date

CHECKED_COLUMNS = ["region", "sr_type", "rca"]


def missing_value_counts(complaints: DataFrame, columns=tuple(CHECKED_COLUMNS),
                         start: DateLike = None, end: DateLike = None) -> DataFrame:
    """(column_name, null_count) for the checked columns, one aggregation."""
    df = date_scope(complaints, start, end)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns])
    return wide.select(F.inline(pairs))


def hourly_counts(complaints: DataFrame) -> DataFrame:
    hour = truncate_to_hour(F.col("sr_open_dttm"))
    return complaints.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def hourly_gaps(complaints: DataFrame, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Hours from start 00:00 to end + 1 day (exclusive) that have no rows.

    Default range: first to last open date of the data.  The expected hours are
    generated from a one-row aggregate (no join to build them), then the hours
    present are removed with an anti join.
    """
    df = date_scope(complaints, start, end)
    lo = df.agg(F.min("sr_open_dt")).scalar() if start is None else lit_date(start)
    hi = df.agg(F.max("sr_open_dt")).scalar() if end is None else lit_date(end)
    first = lo.cast("timestamp_ntz")
    last = F.timestamp_add("HOUR", F.lit(23), hi.cast("timestamp_ntz"))
    expected = df.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    present = hourly_counts(df).select("hour")
    return expected.join(present, "hour", "left_anti")


def validation_issues(complaints: DataFrame, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Issue messages: one per column with nulls, one for missing hours (first 5 listed)."""
    nulls = missing_value_counts(complaints, start=start, end=end).filter(F.col("null_count") > 0).select(
        F.lit("missing_values").alias("check"),
        F.format_string("Found %d rows with missing %s", F.col("null_count"), F.col("column_name")).alias("issue"))
    missing = hourly_gaps(complaints, start, end)
    # the message lists five hours: an ordered limit finds them, not a list of all
    first = missing.orderBy("hour").limit(5).agg(
        F.array_sort(F.collect_list(F.date_format("hour", "yyyy-MM-dd HH:00:00"))).alias("first"))
    gaps = missing.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(first))      # one row each
    gaps = gaps.filter(F.col("n") > 0).select(
        F.lit("missing_hours").alias("check"),
        F.format_string("Missing data for %d hours: %s...", F.col("n"), F.array_join("first", ", ")).alias("issue"))
    return nulls.unionByName(gaps)


def check_schema(df: DataFrame, required: list[str], forbidden: list[str] = ()) -> list[str]:
    """Problems with a frame's columns (metadata only, no data is read)."""
    cols = set(df.columns)
    issues = [f"missing column {c}" for c in required if c not in cols]
    issues += [f"unexpected column {c}" for c in forbidden if c in cols]
    return issues


def schema_issues(tables: dict[str, DataFrame | None], required: dict[str, list[str]],
                  retired: list[str] = ()) -> list[tuple[str, str]]:
    """(table, issue) rows: tables that are absent (None), lack columns, or should be gone (names only, no data is read)."""
    out = [(t, "missing table") for t in required if tables.get(t) is None]
    out += [(t, issue) for t, columns in required.items() if tables.get(t) is not None
            for issue in check_schema(tables[t], columns)]
    return out + [(t, "retired table still exists") for t in retired if tables.get(t) is not None]


def validation_result(complaints: DataFrame, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """One row: status, row_count of the range, issues_found and the issues (a few at most) in order."""
    rows = date_scope(complaints, start, end).agg(F.count(F.lit(1)).alias("row_count"))
    found = validation_issues(complaints, start, end).agg(
        F.count(F.lit(1)).alias("issues_found"), F.array_sort(F.collect_list("issue")).alias("issues"))
    return rows.crossJoin(F.broadcast(found)).select(F.lit("success").alias("status"), "*")      # one row each


def schema_matches(schema: StructType, expected: StructType) -> bool:
    return [(f.name, f.dataType) for f in schema.fields] == [(f.name, f.dataType) for f in expected.fields]


def profile_table(complaints: DataFrame, date_col: str = "sr_open_dt") -> DataFrame:
    """Row count, first / last date and number of distinct dates, one aggregation."""
    return complaints.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(date_col).alias("min_date"),
        F.max(date_col).alias("max_date"), F.count_distinct(date_col).alias("distinct_dates"))


def sample_rows(complaints: DataFrame, n: int = 5) -> DataFrame:
    return complaints.limit(n)


def date_list(complaints: DataFrame, date_col: str = "sr_open_dt") -> DataFrame:
    """(date, rows) of every date in the table."""
    return complaints.groupBy(F.col(date_col).alias("date")).agg(F.count(F.lit(1)).alias("rows"))

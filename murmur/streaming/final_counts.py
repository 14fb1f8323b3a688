"""Structured Streaming: each day's counts once the day has closed, late rows put aside.

``stream_daily_counts`` drops what lies behind its watermark without a trace.
Here every row of the stream ends in exactly one place: in a day's counts, in
the side output (rows of closed days, rows without an open time), or among the
duplicates that the batch log counts.

A day is open until the watermark (the latest open time of all batches so far,
less ``lateness_days``) has passed its end.  A micro-batch

1. takes the watermark that the batch before it left in the log,
2. writes its rows of closed days to ``late``,
3. writes the others to ``accepted`` but for those whose ``sr_number`` an open
   day already has (of equal numbers in a batch the earliest stays),
4. counts the days that its own open times close into ``final``,
5. writes its line of the log.

Every step writes a folder of its own under ``batch=<number>`` and depends on
earlier batches only, so a batch that is run again replaces what it wrote and
nothing else: results hold every row once, whatever fails in between.
Checkpoint and tables belong together; a new checkpoint needs new tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmur.operators.common import resolve_dimensions
from murmur.operators.counts import daily_counts
from murmur.sources.sinks import path_exists

LOG_SCHEMA = ("rows_read bigint, rows_late bigint, rows_accepted bigint, rows_duplicate bigint, latest timestamp_ntz, "
              "open_from date, batch bigint")
FINAL_SCHEMA = "dimension string, dimension_key string, day date, n bigint, batch bigint"


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """A row a batch: rows by where they went, the latest open time so far, the first day still open after it."""
    if not path_exists(spark, f"{root}/log"):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/log")


def read_final(spark: SparkSession, root: str) -> DataFrame:
    """(dimension, dimension_key, day, n) of all closed days."""
    if not path_exists(spark, f"{root}/final"):
        return spark.createDataFrame([], FINAL_SCHEMA).drop("batch")
    return spark.read.schema(FINAL_SCHEMA).parquet(f"{root}/final").drop("batch")


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """The rows that came too late or have no open time, with the ``reason`` and the ``batch``."""
    return spark.read.parquet(f"{root}/late")


def open_counts(spark: SparkSession, root: str, dimensions=None) -> DataFrame:
    """The counts so far of the days that are still open."""
    first, n = read_log(spark, root).agg(F.max("open_from"), F.sum("rows_accepted")).first()
    if not n:
        return spark.createDataFrame([], FINAL_SCHEMA).drop("batch")
    rows = spark.read.parquet(f"{root}/accepted").filter(F.col("sr_open_dt") >= F.lit(first))
    return daily_counts(rows, dimensions, include_total=True)


def apply_counts_batch(batch: DataFrame, number: int, root: str, lateness_days: int = 2, dimensions=None) -> None:
    """The steps above for one batch of complaint rows; may be run again for the same ``number``."""
    spark = batch.sparkSession
    dims = resolve_dimensions(dimensions)
    before = read_log(spark, root).filter(F.col("batch") < number).agg(F.max("latest"), F.max("open_from")).first()
    latest, open_from = before

    day = F.to_date("sr_open_dttm")
    is_late = F.lit(False) if open_from is None else F.coalesce(day < F.lit(open_from), F.lit(False))
    reason = F.when(F.col("sr_open_dttm").isNull(), "no open time").when(is_late, "late")
    marked = batch.withColumn("reason", reason)
    late_path, own_path = f"{root}/late/batch={number}", f"{root}/accepted/batch={number}"
    marked.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(late_path)

    kept = ["sr_number", "sr_open_dttm", *dict.fromkeys(dims.values())]
    timely = marked.filter(F.col("reason").isNull()).select(*kept)
    first = timely.filter(F.col("sr_number").isNotNull()).groupBy("sr_number").agg(
        F.min(F.struct(*[c for c in kept if c != "sr_number"])).alias("_row")).select("sr_number", "_row.*")
    if path_exists(spark, f"{root}/accepted"):
        known = spark.read.schema("sr_number string, sr_open_dt date, batch bigint").parquet(f"{root}/accepted")
        known = known.filter(F.col("batch") < number)
        if open_from is not None:
            known = known.filter(F.col("sr_open_dt") >= F.lit(open_from))       # partitions of open days only
        first = first.join(known.select("sr_number"), "sr_number", "left_anti")
    accepted = first.unionByName(timely.filter(F.col("sr_number").isNull())).withColumn("sr_open_dt", day)
    accepted.write.mode("overwrite").partitionBy("sr_open_dt").parquet(own_path)

    seen = batch.agg(F.count(F.lit(1)).alias("n"), F.max("sr_open_dttm").alias("latest")).first()
    n_late = spark.read.schema(marked.schema).parquet(late_path).count()
    own_schema = accepted.schema
    n_own = spark.read.schema(own_schema).parquet(own_path).count()
    latest = max((t for t in (latest, seen["latest"]) if t is not None), default=None)
    log = spark.range(1).select(
        F.lit(seen["n"]).cast("bigint").alias("rows_read"), F.lit(n_late).cast("bigint").alias("rows_late"),
        F.lit(n_own).cast("bigint").alias("rows_accepted"), F.lit(seen["n"] - n_late - n_own).cast("bigint").alias("rows_duplicate"),
        F.lit(latest).cast("timestamp_ntz").alias("latest"),
        F.date_sub(F.lit(latest).cast("timestamp_ntz").cast("date"), lateness_days).alias("open_from"))

    closing = F.lit(False) if latest is None else F.col("sr_open_dt") < F.date_sub(F.lit(latest).cast("date"), lateness_days)
    if open_from is not None:
        closing = closing & (F.col("sr_open_dt") >= F.lit(open_from))
    rows = spark.read.schema(f"{own_schema.toDDL()}, batch bigint").parquet(f"{root}/accepted")
    closed = daily_counts(rows.filter((F.col("batch") <= number) & closing), dims, include_total=True)
    closed.write.mode("overwrite").parquet(f"{root}/final/batch={number}")
    log.write.mode("overwrite").parquet(f"{root}/log/batch={number}")


def stream_final_counts(stream: DataFrame, root: str, checkpoint: str, lateness_days: int = 2, dimensions=None,
                        available_now: bool = True) -> StreamingQuery:
    """Start the query over a stream of complaint rows; ``read_final``, ``read_late`` and ``open_counts`` read its tables."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: apply_counts_batch(batch, number, root, lateness_days, dimensions))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()

"""Registered queries of the streams: the events' complaints arrive in four parts, the query is restarted for each.

The parts are the days up to the tenth, up to the twentieth, the rest of the
month, and the rows held back (every eleventh), most of them too late.  The
second part brings every thirteenth row of the first again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from murmur.plans.catalog import register
from murmur.plans.oracle import with_complaints
from murmur.session import scratch_table_path
from murmur.sources.tables import complaints
from murmur.streaming.final_counts import open_counts, read_final, read_late, read_log, stream_final_counts

EV = "complaints_ev"


def _streamed(spark, sf_dir) -> str:
    root = scratch_table_path(spark, f"stream-{uuid.uuid4().hex}")
    view = complaints(spark, sf_dir, EV)
    number, day = F.substring("sr_number", 4, 20).cast("bigint"), F.dayofmonth("sr_open_dt")
    part = F.when(number % 11 == 0, 3).when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    parts = [view.filter(part == i) for i in range(4)]
    parts[1] = parts[1].unionByName(view.filter((part == 0) & (number % 13 == 0)))
    for i, rows in enumerate(parts):
        rows.write.parquet(f"{root}/in/part={i}")
        stream = spark.readStream.schema(view.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{root}/in/part=*")
        stream_final_counts(stream.drop("part"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


_PARTS = with_complaints(EV, """
p AS (SELECT *, CAST(substr(sr_number, 4) AS BIGINT) AS id, CASE WHEN CAST(substr(sr_number, 4) AS BIGINT) % 11 = 0 THEN 3
        WHEN dayofmonth(sr_open_dt) <= 10 THEN 0 WHEN dayofmonth(sr_open_dt) <= 20 THEN 1 ELSE 2 END AS part FROM c)""", """
a AS (SELECT id, part, sr_open_dt, sr_type, region, exc_id, city, rca FROM p
      UNION ALL SELECT id, 1, sr_open_dt, sr_type, region, exc_id, city, rca FROM p WHERE part = 0 AND id % 13 = 0)""", """
w AS (SELECT i AS part, (SELECT CAST(max(sr_open_dt) AS DATE) - 2 FROM a WHERE a.part < i) AS first_open FROM range(5) r(i))""", """
m AS (SELECT a.*, coalesce(a.sr_open_dt < w.first_open, false) AS late FROM a JOIN w ON a.part = w.part)""")


@register("stream_late_rows", _PARTS + """
SELECT 'SR-' AS prefix, id, CAST(part AS BIGINT) AS batch FROM m WHERE late""")
def q_stream_late_rows(spark, sf_dir):
    late = read_late(spark, _streamed(spark, sf_dir))
    return late.select(F.substring("sr_number", 1, 3).alias("prefix"), F.substring("sr_number", 4, 20).cast("bigint").alias("id"),
                       F.col("batch").cast("bigint").alias("batch"))


@register("stream_batch_log", _PARTS + """
SELECT CAST(m.part AS BIGINT) AS batch, count(*) AS rows_read, count(*) FILTER (late) AS rows_late,
       count(*) FILTER (NOT late AND NOT (m.part = 1 AND dayofmonth(sr_open_dt) <= 10)) AS rows_accepted,
       count(*) FILTER (NOT late AND m.part = 1 AND dayofmonth(sr_open_dt) <= 10) AS rows_duplicate
FROM m GROUP BY m.part""")
def q_stream_batch_log(spark, sf_dir):
    return read_log(spark, _streamed(spark, sf_dir)).select("batch", "rows_read", "rows_late", "rows_accepted", "rows_duplicate")


@register("stream_daily_counts", _PARTS + """
, k AS (SELECT *, sr_open_dt >= (SELECT first_open FROM w WHERE part = 4) AS still_open FROM m
        WHERE NOT late AND NOT (part = 1 AND dayofmonth(sr_open_dt) <= 10))
SELECT dimension, dimension_key, sr_open_dt AS day, still_open, count(*) AS n FROM (
  SELECT 'Type' AS dimension, sr_type AS dimension_key, sr_open_dt, still_open FROM k
  UNION ALL SELECT 'Region', region, sr_open_dt, still_open FROM k
  UNION ALL SELECT 'Exchange', exc_id, sr_open_dt, still_open FROM k
  UNION ALL SELECT 'City', city, sr_open_dt, still_open FROM k
  UNION ALL SELECT 'RCA', rca, sr_open_dt, still_open FROM k
  UNION ALL SELECT 'Total', 'Total', sr_open_dt, still_open FROM k)
GROUP BY ALL""")
def q_stream_daily_counts(spark, sf_dir):
    """Final counts of closed days and the counts so far of open ones."""
    root = _streamed(spark, sf_dir)
    final, running = read_final(spark, root), open_counts(spark, root)
    columns = ["dimension", "dimension_key", "day", "n"]
    return final.select(*columns, F.lit(False).alias("still_open")).unionByName(
        running.select(*columns, F.lit(True).alias("still_open")))

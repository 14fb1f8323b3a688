"""Registered queries of the stored tables: written, changed by a batch and read back.

The complaint view of ``events`` comes in two batches.  The base holds all
complaints but every seventh; the batch brings those (inserts) and, of the
others, every fifth as closed ten hours after opening in another region, a
third of these moved to a date three days later.  ``rca`` and ``city`` are not
supplied by the batch: stored values stay, new rows have none.  Together the
two batches hold the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.anomalies import anomalies_from_baselines
from murmur.operators.baselines import daily_baselines
from murmur.operators.counts import daily_counts
from murmur.operators.resolution import aging_from_backlog, mttr_from_resolved
from murmur.plans.catalog import register
from murmur.plans.incremental import apply_batch
from murmur.plans.oracle import dc_cte, with_complaints
from murmur.plans.queries_core import _BASELINE_SQL
from murmur.plans.queries_ops import _aging_sql, _mttr_sql
from murmur.session import scratch_table_path
from murmur.sources.sinks import delete_date_range, read_baselines, replace_by_date, write_baselines
from murmur.sources.tables import VIEW_SQL, complaints

EV = "complaints_ev"
CHANGED = "complaints_ev_changed"

VIEW_SQL[CHANGED] = f"""
  SELECT sr_number, mdn, sr_open_dttm + to_days(moved * 3) AS sr_open_dttm,
         CAST(sr_open_dt + to_days(moved * 3) AS DATE) AS sr_open_dt,
         CASE WHEN updated THEN sr_open_dttm + to_days(moved * 3) + INTERVAL 10 HOUR ELSE sr_close_dttm END AS sr_close_dttm,
         CASE WHEN updated THEN 'Closed' ELSE sr_status END AS sr_status, sr_type, sr_sub_type,
         CASE WHEN added THEN NULL ELSE rca END AS rca, CASE WHEN updated THEN 'MOVED' ELSE region END AS region, exc_id,
         CASE WHEN added THEN NULL ELSE city END AS city
  FROM (SELECT *, id % 7 = 3 AS added, id % 7 <> 3 AND id % 5 = 1 AS updated,
               CASE WHEN id % 7 <> 3 AND id % 5 = 1 AND id % 3 = 0 THEN 1 ELSE 0 END AS moved
        FROM (SELECT *, CAST(substr(sr_number, 4) AS BIGINT) AS id FROM ({VIEW_SQL[EV]}) v) w) x"""


def _number():
    return F.substring("sr_number", 4, 20).cast("bigint")


def split_base(view: DataFrame) -> DataFrame:
    return view.filter(_number() % 7 != 3)


def change_batch(view: DataFrame) -> DataFrame:
    added = _number() % 7 == 3
    days = F.when(~added & (_number() % 3 == 0), 3).otherwise(0)
    opened = F.timestamp_add("DAY", days, F.col("sr_open_dttm"))
    return view.filter(added | (_number() % 5 == 1)).withColumns({
        "sr_close_dttm": F.when(added, F.col("sr_close_dttm")).otherwise(F.timestamp_add("HOUR", F.lit(10), opened)),
        "sr_status": F.when(added, F.col("sr_status")).otherwise("Closed"),
        "region": F.when(added, F.col("region")).otherwise("MOVED"),
        "sr_open_dttm": opened, "sr_open_dt": F.date_add("sr_open_dt", days),
        "rca": F.lit(None).cast("string"), "city": F.lit(None).cast("string")})


def _state(spark, sf_dir, *projections: str) -> str:
    root = scratch_table_path(spark, f"state-{uuid.uuid4().hex}")
    view = complaints(spark, sf_dir, EV)
    supplied = [c for c in view.columns if c not in ("rca", "city")]
    apply_batch(spark, root, split_base(view), supplied, projections)
    apply_batch(spark, root, change_batch(view), supplied, projections)
    return root


@register("upsert_complaints", with_complaints(CHANGED) + "SELECT * FROM c")
def q_upsert_complaints(spark, sf_dir):
    columns = complaints(spark, sf_dir, EV).columns
    return spark.read.parquet(f"{_state(spark, sf_dir)}/complaints").select(*columns)


@register("counts_after_batch", with_complaints(CHANGED, dc_cte(include_total=True)) + "SELECT dimension, dimension_key, day, n FROM dc")
def q_counts_after_batch(spark, sf_dir):
    return spark.read.parquet(f"{_state(spark, sf_dir, 'counts')}/counts").select("dimension", "dimension_key", "day", "n")


@register("mttr_after_batch", _mttr_sql(CHANGED))
def q_mttr_after_batch(spark, sf_dir):
    return mttr_from_resolved(spark.read.parquet(f"{_state(spark, sf_dir, 'resolved')}/resolved"))


@register("aging_after_batch", _aging_sql(CHANGED))
def q_aging_after_batch(spark, sf_dir):
    root = _state(spark, sf_dir, "backlog")
    last = spark.read.parquet(f"{root}/complaints").agg(F.max("sr_open_dt")).scalar()
    return aging_from_backlog(spark.read.parquet(f"{root}/backlog"), None, last)


# -- replaced and deleted dates ---------------------------------------------------
@register("replace_by_date", with_complaints(EV, dc_cte()) + """
SELECT dimension, dimension_key, day, CASE WHEN dimension = 'Region' AND dayofmonth(day) <= 10 THEN n * 2 ELSE n END AS n
FROM dc WHERE NOT (dimension = 'City' AND dayofmonth(day) <= 10)""")
def q_replace_by_date(spark, sf_dir):
    """All counts stored; then Region and City of the days up to the tenth replaced: Region doubled, City by nothing."""
    table = scratch_table_path(spark, f"replace-{uuid.uuid4().hex}")
    counts = daily_counts(complaints(spark, sf_dir, EV))
    every = [r[0] for r in counts.select("day").distinct().collect()]       # a row a date
    replace_by_date(spark, counts, table, "day", every)
    stored = spark.read.parquet(table)
    early = [d for d in every if d.day <= 10]
    new = stored.filter((F.col("dimension") == "Region") & F.col("day").isin(*early)).withColumn("n", F.col("n") * 2)
    replace_by_date(spark, new, table, "day", early, ["Region", "City"])
    return spark.read.parquet(table).select("dimension", "dimension_key", "day", "n")


@register("delete_date_range", with_complaints(EV) + """
SELECT 'complaints' AS table, count(CASE WHEN dayofmonth(sr_open_dt) BETWEEN 5 AND 20 THEN 1 END) AS removed,
       count(CASE WHEN dayofmonth(sr_open_dt) NOT BETWEEN 5 AND 20 THEN 1 END) AS stay
FROM c WHERE sr_open_dt BETWEEN (SELECT date_trunc('month', min(sr_open_dt)) FROM c)
                            AND (SELECT last_day(min(sr_open_dt)) FROM c)""")
def q_delete_date_range(spark, sf_dir):
    """The first month stored by date, the days from the fifth to the twentieth deleted."""
    table = scratch_table_path(spark, f"delete-{uuid.uuid4().hex}")
    view = complaints(spark, sf_dir, EV)
    month = view.agg(F.min("sr_open_dt")).first()[0].replace(day=1)
    days = view.filter((F.trunc("sr_open_dt", "MM") == F.lit(month)))
    days.write.partitionBy("sr_open_dt").parquet(table)
    gone = delete_date_range(spark, {"complaints": table}, month.replace(day=5), month.replace(day=20))
    stay = spark.read.schema(days.schema).parquet(table).agg(F.count(F.lit(1)).alias("stay"))
    return gone.join(F.broadcast(stay), F.lit(True))


# -- stored baselines, taken as of the target date -----------------------------------
@register("anomalies_asof_baselines", "WITH stored AS (SELECT * FROM (" + _BASELINE_SQL + """) x WHERE dayofmonth(as_of) % 7 = 1
), counts AS (SELECT * FROM (""" + with_complaints(EV, dc_cte()) + """SELECT dimension, dimension_key, day, n FROM dc) y
), j AS (
  SELECT c.day AS anomaly_date, c.dimension, coalesce(c.dimension_key, 'None') AS dimension_key, CAST(c.n AS DOUBLE) AS metric_value,
         coalesce(s.avg_30d, 0.0E0) AS baseline_avg, coalesce(s.std_30d, 0.0E0) AS baseline_std
  FROM counts c ASOF LEFT JOIN stored s
    ON c.dimension = s.dimension AND c.dimension_key = s.dimension_key AND c.day >= s.as_of
), z AS (SELECT *, (metric_value - baseline_avg) / (baseline_std + 1.0E-3) AS z_score FROM j)
SELECT anomaly_date, dimension, dimension_key, metric_value, baseline_avg, baseline_std, z_score,
       CASE WHEN z_score > 3.0E0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, '' AS rca_context
FROM z WHERE z_score > 2.0E0""")
def q_anomalies_asof_baselines(spark, sf_dir):
    """Baselines stored once a week, every count held against the latest one of its key."""
    path = scratch_table_path(spark, f"baselines-{uuid.uuid4().hex}")
    counts = daily_counts(complaints(spark, sf_dir, EV))
    weekly = counts.select(F.col("day").alias("as_of")).distinct().filter(F.dayofmonth("as_of") % 7 == 1)
    write_baselines(daily_baselines(counts, targets=weekly), path)
    return anomalies_from_baselines(counts, read_baselines(spark, path))

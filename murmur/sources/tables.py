"""Readers for the driver's parquet tables and the complaint views built on them.

The driver publishes TPC-H-like tables, no complaint table.  Two views map
them onto the complaint schema so that every operator runs on data whose size
grows with the scale factor:

* ``complaints_ev``: events joined to customer / nation / region, one month of
  timestamps, dense per day (baselines, anomalies, trends, surges, repeats,
  resolution times).
* ``complaints_ord``: orders joined to customer / nation / region, 1995-2001,
  sparse per day (month-over-month, long ageing).

``complaints_view_sql`` renders the same views as DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (c_custkey, region, exc_id, city).

    nation (25 rows) and region (5 rows) are fixed-size dimension tables; the
    planner broadcasts them from file statistics.  customer grows with the
    data, so its join strategy is left to the planner and AQE.
    """
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return customer.join(geo, customer.c_nationkey == geo.n_nationkey).select(
        "c_custkey",
        F.col("r_name").alias("region"),
        F.col("n_name").alias("exc_id"),
        F.col("c_mktsegment").alias("city"),
    )


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def truncate_to_second(c: Column) -> Column:
    """Drop sub-second digits of a TIMESTAMP_NTZ without a time-zone round trip."""
    frac_micros = ((F.date_part(F.lit("SECOND"), c) * 1000000).cast("bigint")) % 1000000
    return F.timestamp_add("MICROSECOND", -frac_micros, c)


def complaints_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaint view over ``events`` (see module doc)."""
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    ev = ev.withColumn("k", k)
    opened = truncate_to_second(_ntz(F.col("ts")))
    close_secs = F.floor(F.col("value") * F.when(F.col("k") % 11 == 0, 60).otherwise(3600)).cast("bigint")
    df = ev.join(_geo(spark, sf_dir), ev.user_id == F.col("c_custkey"))
    df = df.select(
        F.concat(F.lit("SR-"), F.col("event_id").cast("string")).alias("sr_number"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 (F.col("event_id") % (F.col("user_id") % 60 + 1)).cast("string")).alias("mdn"),
        opened.alias("sr_open_dttm"),
        F.to_date(opened).alias("sr_open_dt"),
        F.when(F.col("k") % 5 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.timestamp_add("SECOND", close_secs, opened)).alias("sr_close_dttm"),
        F.when(F.col("k") % 5 == 0, "Open").when(F.col("k") % 13 == 0, "Pending")
         .otherwise("Closed").alias("sr_status"),
        F.col("event_type").alias("sr_type"),
        F.concat(F.lit("SUB_"), (F.col("k") % 12).cast("string")).alias("sr_sub_type"),
        F.when(F.col("k") % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("RCA_"), (F.col("k") % 7).cast("string"))).alias("rca"),
        "region", "exc_id", "city",
    )
    return df


def complaints_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaint view over ``orders`` (see module doc)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    opened = F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, _ntz(F.col("o_orderdate")))
    df = o.join(_geo(spark, sf_dir), o.o_custkey == F.col("c_custkey"))
    return df.select(
        F.concat(F.lit("SO-"), F.col("o_orderkey").cast("string")).alias("sr_number"),
        F.col("o_custkey").cast("string").alias("mdn"),
        opened.alias("sr_open_dttm"),
        F.to_date(opened).alias("sr_open_dt"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.timestamp_add("HOUR", F.col("o_orderkey") % 2000, opened)).alias("sr_close_dttm"),
        F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "P", "Pending")
         .when(F.col("o_orderstatus") == "F", "Closed").alias("sr_status"),
        F.col("o_orderpriority").alias("sr_type"),
        F.concat(F.lit("SUB_"), (F.col("o_orderkey") % 12).cast("string")).alias("sr_sub_type"),
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("RCA_"), (F.col("o_orderkey") % 7).cast("string"))).alias("rca"),
        "region", "exc_id", "city",
    )


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL (used by the oracle side of the correctness check)
# ---------------------------------------------------------------------------
_GEO_SQL = """
  SELECT c.c_custkey, r.r_name AS region, n.n_name AS exc_id, c.c_mktsegment AS city
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey"""

_EV_SQL = f"""
  SELECT 'SR-' || CAST(e.event_id AS VARCHAR) AS sr_number,
         CAST(e.user_id AS VARCHAR) || '-' || CAST(e.event_id % (e.user_id % 60 + 1) AS VARCHAR) AS mdn,
         CAST(date_trunc('second', e.ts) AS TIMESTAMP) AS sr_open_dttm,
         CAST(date_trunc('second', e.ts) AS DATE) AS sr_open_dt,
         CASE WHEN e.k % 5 = 0 THEN NULL
              ELSE CAST(date_trunc('second', e.ts) AS TIMESTAMP)
                   + to_seconds(CAST(floor(e.value * CASE WHEN e.k % 11 = 0 THEN 60 ELSE 3600 END) AS BIGINT))
         END AS sr_close_dttm,
         CASE WHEN e.k % 5 = 0 THEN 'Open' WHEN e.k % 13 = 0 THEN 'Pending' ELSE 'Closed' END AS sr_status,
         e.event_type AS sr_type,
         'SUB_' || CAST(e.k % 12 AS VARCHAR) AS sr_sub_type,
         CASE WHEN e.k % 10 = 0 THEN NULL ELSE 'RCA_' || CAST(e.k % 7 AS VARCHAR) END AS rca,
         g.region, g.exc_id, g.city
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
  JOIN ({_GEO_SQL}) g ON e.user_id = g.c_custkey"""

_ORD_SQL = f"""
  SELECT 'SO-' || CAST(o.o_orderkey AS VARCHAR) AS sr_number,
         CAST(o.o_custkey AS VARCHAR) AS mdn,
         CAST(o.o_orderdate AS TIMESTAMP) + to_seconds(o.o_orderkey % 86400) AS sr_open_dttm,
         CAST(CAST(o.o_orderdate AS TIMESTAMP) + to_seconds(o.o_orderkey % 86400) AS DATE) AS sr_open_dt,
         CASE WHEN o.o_orderstatus = 'O' THEN NULL
              ELSE CAST(o.o_orderdate AS TIMESTAMP) + to_seconds(o.o_orderkey % 86400)
                   + to_hours(o.o_orderkey % 2000) END AS sr_close_dttm,
         CASE o.o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Closed' END AS sr_status,
         o.o_orderpriority AS sr_type,
         'SUB_' || CAST(o.o_orderkey % 12 AS VARCHAR) AS sr_sub_type,
         CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE 'RCA_' || CAST(o.o_orderkey % 7 AS VARCHAR) END AS rca,
         g.region, g.exc_id, g.city
  FROM orders o JOIN ({_GEO_SQL}) g ON o.o_custkey = g.c_custkey"""

VIEW_SQL = {"complaints_ev": _EV_SQL, "complaints_ord": _ORD_SQL}

VIEWS = {"complaints_ev": complaints_ev, "complaints_ord": complaints_ord}


def complaints(spark: SparkSession, sf_dir: str, view: str = "complaints_ev") -> DataFrame:
    return VIEWS[view](spark, sf_dir)


def complaints_view_sql(view: str = "complaints_ev", alias: str = "c") -> str:
    """``WITH``-clause item defining ``alias`` as the named view in DuckDB SQL."""
    return f"{alias} AS ({VIEW_SQL[view]}\n)"

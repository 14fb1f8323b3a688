"""Enrichment of anomalies: correlated keys, probable root causes, severity
refinement and narrative insights.

Everything works on a whole set of anomaly dates at once and is expressed as
equi-joins and window functions over the small aggregated tables
(``daily_counts`` and per-day rca counts); raw complaint rows are
pre-aggregated before any join with the anomalies.

* correlation: for an anomaly on t, the top 5 types and top 5 regions by rows
  in [t - 30, t] (other dimensions only; ties by key) are candidates; Pearson
  r between the two daily series over their common days (at least 3); r > 0.7
  is kept.  Text ``Correlated with: K (0.98), ...``, types before regions.
* root causes: share of the 3 most frequent ``rca`` values (null counts, and
  prints as 'None') among the anomaly's rows that day; text
  ``Probable RCA: X (50.0%), ...``.  Default dimensions Type, Region, Exchange.
* severity: WARNING becomes CRITICAL when the same key was anomalous the day
  before, or when it is a Type anomaly on a day with more than 3 Region
  anomalies.
* narrative: title ``Spike in K (D)`` and a summary line, INFO skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.constants import (CORRELATION_HISTORY_DAYS, CORRELATION_MIN, CORRELATION_MIN_DAYS,
                              CORRELATION_TOP, ROOT_CAUSES_KEPT, WIDESPREAD_REGION_ANOMALIES)
from murmur.functions.stats import round_half_up
from murmur.operators.anomalies import ANOMALY_COLUMNS

RCA_DIMENSIONS = {"Type": "sr_type", "Region": "region", "Exchange": "exc_id"}
CORRELATION_TARGETS = ["Type", "Region"]


def _fixed(x: Column, digits: int) -> Column:
    """Text of x with ``digits`` decimals (rounded half up first, so every engine prints the same)."""
    return F.format_string(f"%.{digits}f", round_half_up(x, digits))


def top_keys(counts: DataFrame, dates: DataFrame, k: int = CORRELATION_TOP,
             history_days: int = CORRELATION_HISTORY_DAYS,
             dimensions=tuple(CORRELATION_TARGETS)) -> DataFrame:
    """(t, dimension, dimension_key, rows, rank) for the top ``k`` keys of each
    dimension by rows in [t - history, t]; ``dates`` has column ``t``.

    Each daily count is copied to the ``history + 1`` dates it is history for,
    restricted to the requested dates; a window with a row limit keeps the top
    k per (t, dimension) (planned as a per-group limit before the sort).
    """
    c = counts.filter(F.col("dimension").isin(*dimensions))
    ex = c.select("dimension", "dimension_key", "n", "day",
                  F.explode(F.sequence(F.lit(0), F.lit(history_days))).alias("_lag")) \
        .select("dimension", "dimension_key", "n", F.date_add("day", F.col("_lag")).alias("t"))
    ex = ex.join(dates.select("t").distinct(), "t", "left_semi")
    tot = ex.groupBy("t", "dimension", "dimension_key").agg(F.sum("n").alias("rows"))
    w = Window.partitionBy("t", "dimension").orderBy(F.desc("rows"), F.asc_nulls_first("dimension_key"))
    return tot.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def day_vectors(counts: DataFrame, wanted: DataFrame, history_days: int = CORRELATION_HISTORY_DAYS) -> DataFrame:
    """The columns of ``wanted`` (t, dimension, dimension_key and others) and ``days``: the counts of the key
    from t back to ``history_days`` before, as a map by day.

    A key's counts are packed into one row, a number a day, and joined by key;
    no row is copied to other days.  Null keys and those without counts have no vector.
    """
    keys = ["dimension", "dimension_key"]
    packed = counts.groupBy(*keys).agg(F.collect_list(F.struct("day", "n")).alias("_points"))
    near = F.filter("_points", lambda p: (p["day"] <= F.col("t")) & (p["day"] >= F.date_sub("t", history_days)))
    return wanted.join(packed, keys).select(*wanted.columns, F.map_from_entries(near).alias("days"))


def anomaly_correlations(anomalies: DataFrame, counts: DataFrame, k: int = CORRELATION_TOP,
                         min_r: float = CORRELATION_MIN, min_days: int = CORRELATION_MIN_DAYS,
                         history_days: int = CORRELATION_HISTORY_DAYS) -> DataFrame:
    """(anomaly_date, dimension, dimension_key, target_dimension, target_key, target_rank, r, common_days)
    for every candidate pair with r > min_r.

    One join by date brings the day vectors of a pair together; its sums are
    dot products over their common days.
    """
    a = anomalies.select(F.col("anomaly_date").alias("t"), "dimension", "dimension_key")
    tops = top_keys(counts, a, k, history_days).filter(F.col("dimension_key").isNotNull()) \
        .select("t", "dimension", "dimension_key", F.col("rank").alias("target_rank"))
    own = day_vectors(counts, a, history_days)
    target = day_vectors(counts, tops, history_days).select(
        "t", F.col("dimension").alias("target_dimension"), F.col("dimension_key").alias("target_key"), "target_rank",
        F.col("days").alias("_days"))
    pairs = own.join(target, "t").filter(F.col("dimension") != F.col("target_dimension"))
    both = F.transform(F.map_entries("days"), lambda e: F.struct(
        e["value"].alias("x"), F.try_element_at("_days", e["key"]).alias("y")))
    common = F.filter(both, lambda d: d["y"].isNotNull())

    def add(s, d):
        x, y = d["x"].cast("double"), d["y"].cast("double")
        return F.struct((s["sx"] + x).alias("sx"), (s["sy"] + y).alias("sy"), (s["sxx"] + x * x).alias("sxx"),
                        (s["syy"] + y * y).alias("syy"), (s["sxy"] + x * y).alias("sxy"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])
    g = pairs.withColumn("_common", common).filter(F.size("_common") >= min_days).select(
        "t", "dimension", "dimension_key", "target_dimension", "target_key", "target_rank",
        F.size("_common").cast("long").alias("common_days"), F.inline(F.array(F.aggregate("_common", zero, add))))
    n = F.col("common_days").cast("double")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    r = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return g.select(F.col("t").alias("anomaly_date"), "dimension", "dimension_key", "target_dimension",
                    "target_key", "target_rank", r.alias("r"), "common_days") \
        .filter(F.col("r") > min_r)


def correlation_context(correlations: DataFrame) -> DataFrame:
    """(anomaly_date, dimension, dimension_key, correlation_text)."""
    order = F.when(F.col("target_dimension") == "Type", 0).otherwise(1)
    item = F.struct(order.alias("o"), F.col("target_rank").alias("r"),
                    F.concat(F.col("target_key"), F.lit(" ("), _fixed(F.col("r"), 2), F.lit(")")).alias("txt"))
    g = correlations.groupBy("anomaly_date", "dimension", "dimension_key").agg(
        F.array_sort(F.collect_list(item)).alias("_items"))
    return g.select("anomaly_date", "dimension", "dimension_key",
                    F.concat(F.lit("Correlated with: "),
                             F.array_join(F.transform("_items", lambda s: s["txt"]), ", ")).alias("correlation_text"))


def daily_rca_counts(complaints: DataFrame, dimensions: dict | None = None, weight: Column | None = None) -> DataFrame:
    """(day, dimension, dimension_key, rca, n): rows (or their ``weight``) per key and root cause, one pass."""
    dims = RCA_DIMENSIONS if dimensions is None else dimensions
    pairs = F.array(*[F.struct(F.lit(nm).alias("dimension"), F.col(col).cast("string").alias("dimension_key"))
                      for nm, col in dims.items()])
    n = (F.lit(1) if weight is None else weight).cast("bigint")
    long = complaints.select(F.col("sr_open_dt").alias("day"), "rca", n.alias("n"), F.inline(pairs))
    return long.groupBy("day", "dimension", "dimension_key", "rca").agg(F.sum("n").alias("n"))


def top_root_causes(anomalies: DataFrame, rca_counts: DataFrame, k: int = ROOT_CAUSES_KEPT) -> DataFrame:
    """(anomaly_date, dimension, dimension_key, rca, n, share_pct, rank) for the top ``k`` root causes."""
    a = anomalies.select(F.col("anomaly_date").alias("day"), "dimension", "dimension_key")
    rc = rca_counts.join(a, ["day", "dimension", "dimension_key"], "left_semi")
    by_key = Window.partitionBy("day", "dimension", "dimension_key")
    ranked = rc.select("*", F.sum("n").over(by_key).alias("_total"),
                       F.row_number().over(by_key.orderBy(F.desc("n"), F.asc_nulls_first("rca"))).alias("rank"))
    return ranked.filter(F.col("rank") <= k).select(
        F.col("day").alias("anomaly_date"), "dimension", "dimension_key", "rca", "n",
        (F.col("n") / F.col("_total") * 100.0).alias("share_pct"), "rank")


def rca_context(root_causes: DataFrame) -> DataFrame:
    item = F.struct(F.col("rank").alias("r"),
                    F.concat(F.coalesce(F.col("rca"), F.lit("None")), F.lit(" ("), _fixed(F.col("share_pct"), 1),
                             F.lit("%)")).alias("txt"))
    g = root_causes.groupBy("anomaly_date", "dimension", "dimension_key").agg(
        F.array_sort(F.collect_list(item)).alias("_items"))
    return g.select("anomaly_date", "dimension", "dimension_key",
                    F.concat(F.lit("Probable RCA: "),
                             F.array_join(F.transform("_items", lambda s: s["txt"]), ", ")).alias("rca_text"))


def refine_severity(anomalies: DataFrame, widespread: int = WIDESPREAD_REGION_ANOMALIES) -> DataFrame:
    """WARNING -> CRITICAL when persistent (same key anomalous the previous day)
    or Type on a widespread day (more than ``widespread`` Region anomalies)."""
    prev = anomalies.select(F.date_add("anomaly_date", 1).alias("anomaly_date"), "dimension", "dimension_key",
                            F.lit(True).alias("_persistent")).distinct()
    j = anomalies.join(prev, ["anomaly_date", "dimension", "dimension_key"], "left")
    # Region anomalies per date, counted map-side: a day's anomalies never meet in one task
    wide = (anomalies.filter(F.col("dimension") == "Region").groupBy("anomaly_date")
            .agg((F.count(F.lit(1)) > widespread).alias("_wide")))
    j = j.join(wide, "anomaly_date", "left").withColumn("_wide", F.coalesce("_wide", F.lit(False)))
    upgrade = (F.col("severity") == "WARNING") & (
        F.coalesce(F.col("_persistent"), F.lit(False)) | (F.col("_wide") & (F.col("dimension") == "Type")))
    return j.withColumn("severity", F.when(upgrade, "CRITICAL").otherwise(F.col("severity"))) \
        .select(*ANOMALY_COLUMNS)


def enrich_anomalies(anomalies: DataFrame, counts: DataFrame, rca_counts: DataFrame) -> DataFrame:
    """Correlation, then root cause, then severity, as the daily pipeline orders them."""
    keys = ["anomaly_date", "dimension", "dimension_key"]
    corr = correlation_context(anomaly_correlations(anomalies, counts))
    rca = rca_context(top_root_causes(anomalies, rca_counts))
    j = anomalies.join(corr, keys, "left").join(rca, keys, "left")
    ctx = F.concat_ws(" | ", F.col("correlation_text"), F.col("rca_text"))
    j = j.withColumn("rca_context", ctx).select(*ANOMALY_COLUMNS)
    return refine_severity(j)


def narrate(anomalies: DataFrame, with_dimension: bool = False) -> DataFrame:
    """Executive insight rows: (created_at, title, summary, severity, z_score[, dimension])."""
    a = anomalies.filter(F.col("severity") != "INFO")
    title = F.concat(F.lit("Spike in "), F.col("dimension_key"), F.lit(" ("), F.col("dimension"), F.lit(")"))
    summary = F.concat(
        F.lit("On "), F.date_format("anomaly_date", "yyyy-MM-dd"), F.lit(", detected "),
        F.col("metric_value").cast("bigint").cast("string"), F.lit(" complaints (Baseline: "),
        _fixed(F.col("baseline_avg"), 1), F.lit("). Deviation: "), _fixed(F.col("z_score"), 1),
        F.lit("σ. Severity: "), F.col("severity"), F.lit(". "),
        F.when(F.coalesce(F.col("rca_context"), F.lit("")) != "",
               F.concat(F.lit("\nContext: "), F.col("rca_context"))).otherwise(F.lit("")),
    )
    return a.select(F.col("anomaly_date").cast("timestamp_ntz").alias("created_at"), title.alias("title"),
                    summary.alias("summary"), "severity", "z_score", *(["dimension"] if with_dimension else []))


def filter_insights(insights: DataFrame, since) -> DataFrame:
    """Insights created on or after ``since`` (a date, a text or a column), newest first."""
    first = since if isinstance(since, Column) else F.lit(str(since))
    return insights.filter(F.col("created_at") >= first.cast("timestamp_ntz")) \
        .orderBy(F.desc("created_at"), F.desc("z_score"))


def persistent_anomalies(anomalies: DataFrame) -> DataFrame:
    """Anomalies whose (dimension, key) was also anomalous the day before (an equi-join)."""
    prev = anomalies.select(F.date_add("anomaly_date", 1).alias("anomaly_date"), "dimension",
                            "dimension_key").distinct()
    return anomalies.join(prev, ["anomaly_date", "dimension", "dimension_key"], "left_semi")

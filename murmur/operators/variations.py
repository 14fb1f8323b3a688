"""Period-over-period variations (DOD, WOW, MOM) of daily counts.

For target date t, only keys with rows on t are compared:

* DOD: count on t vs count on t - 7 (same weekday).
* WOW: mean over days with data in [Monday(t), t] vs [Monday(t) - 7, t - 7].
* MOM: mean over days with data in [1st of month, t] vs the previous month's
  1st + the same offset (the offset may spill into the current month: 31 March
  compares 1 February .. 3 March).

percent = (c - p) / p * 100, significant when |percent| >= threshold; p = 0
gives 100 % (significant) when c > 0, else 0 %.  A null key is reported as
'None' with zeros, as an equality filter on null matches nothing.

Plan: each daily count is copied to the target dates it can contribute to (the
next 62 days; rows that contribute to nothing are dropped inside the scan
stage), then one aggregation per (dimension, key, target) computes all six
conditional sums.  One shuffle, input is the small daily_counts table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.constants import VARIATION_THRESHOLD
from murmur.operators.common import DateLike, date_scope, target_filter
from murmur.operators.counts import daily_counts

VARIATION_COLUMNS = ["variation_date", "dimension", "dimension_key", "current_value", "previous_value",
                     "variation_type", "variation_percent", "is_significant"]
HORIZON_DAYS = 62   # largest distance between a target and a day it reads


def monday(c):
    return F.trunc(c, "week")


def variation_percent(cur, prev, threshold: float = VARIATION_THRESHOLD):
    pct = (F.when(prev == 0, F.when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
           .otherwise((cur - prev) / prev * 100.0))
    sig = (F.when(prev == 0, F.when(cur > 0, 1).otherwise(0))
           .otherwise(F.when(F.abs((cur - prev) / prev * 100.0) >= threshold, 1).otherwise(0)))
    return pct, sig


def variations_from_counts(counts: DataFrame, start: DateLike = None, end: DateLike = None,
                           threshold: float = VARIATION_THRESHOLD, drop_null_keys: bool = False) -> DataFrame:
    """Variations for every target date of ``counts`` in [start, end] (include Total in counts)."""
    if drop_null_keys:
        counts = counts.filter(F.col("dimension_key").isNotNull())
    t, d = F.col("t"), F.col("day")
    ms = F.trunc(t, "month")
    pms = F.add_months(ms, -1)
    pme = F.date_add(pms, F.datediff(t, ms))
    flags = {
        "is_cur": d == t,
        "is_dod": d == F.date_sub(t, 7),
        "is_wc": (d >= monday(t)) & (d <= t),
        "is_wp": (d >= F.date_sub(monday(t), 7)) & (d <= F.date_sub(t, 7)),
        "is_mc": (d >= ms) & (d <= t),
        "is_mp": (d >= pms) & (d <= pme),
    }
    copies = (counts
              .select("dimension", "dimension_key", "day", "n",
                      F.explode(F.sequence(F.lit(0), F.lit(HORIZON_DAYS))).alias("_j"))
              .select("dimension", "dimension_key", "day", "n", F.date_add("day", F.col("_j")).alias("t"))
              .filter(target_filter("t", start, end))
              .select("dimension", "dimension_key", "t", "n", *[v.alias(k) for k, v in flags.items()])
              .filter(F.col("is_cur") | F.col("is_dod") | F.col("is_wc") | F.col("is_wp")
                      | F.col("is_mc") | F.col("is_mp")))
    n = F.col("n").cast("double")

    def s(flag):
        return F.sum(F.when(F.col(flag), n))

    def c(flag):
        return F.count(F.when(F.col(flag), 1))

    g = copies.groupBy("dimension", "dimension_key", "t").agg(
        F.max("is_cur").alias("_active"), s("is_cur").alias("cur"), s("is_dod").alias("dod_prev"),
        s("is_wc").alias("_wcs"), c("is_wc").alias("_wcc"), s("is_wp").alias("_wps"), c("is_wp").alias("_wpc"),
        s("is_mc").alias("_mcs"), c("is_mc").alias("_mcc"), s("is_mp").alias("_mps"), c("is_mp").alias("_mpc"),
    ).filter(F.col("_active"))

    def mean(sc, cc):
        return F.when(F.col(cc) > 0, F.col(sc) / F.col(cc)).otherwise(F.lit(0.0))

    null_key = F.col("dimension_key").isNull()

    def z(v):
        return F.when(null_key, F.lit(0.0)).otherwise(F.coalesce(v, F.lit(0.0)))

    vals = g.select(
        F.col("t").alias("variation_date"), "dimension",
        F.coalesce(F.col("dimension_key"), F.lit("None")).alias("dimension_key"),
        z(F.col("cur")).alias("dod_c"), z(F.col("dod_prev")).alias("dod_p"),
        z(mean("_wcs", "_wcc")).alias("wow_c"), z(mean("_wps", "_wpc")).alias("wow_p"),
        z(mean("_mcs", "_mcc")).alias("mom_c"), z(mean("_mps", "_mpc")).alias("mom_p"),
    )
    rows = []
    for vt, cc, pc in (("DOD", "dod_c", "dod_p"), ("WOW", "wow_c", "wow_p"), ("MOM", "mom_c", "mom_p")):
        pct, sig = variation_percent(F.col(cc), F.col(pc), threshold)
        rows.append(F.struct(F.col(cc).alias("current_value"), F.col(pc).alias("previous_value"),
                             F.lit(vt).alias("variation_type"), pct.alias("variation_percent"),
                             sig.cast("int").alias("is_significant")))
    return vals.select("variation_date", "dimension", "dimension_key", F.inline(F.array(*rows))) \
               .select(*VARIATION_COLUMNS)


def daily_variations(complaints: DataFrame, start: DateLike = None, end: DateLike = None,
                     dimensions=None, threshold: float = VARIATION_THRESHOLD,
                     drop_null_keys: bool = False) -> DataFrame:
    """Variations for target dates in [start, end], all dimensions plus Total."""
    scoped = date_scope(complaints, start, end, lookback_days=HORIZON_DAYS)
    counts = daily_counts(scoped, dimensions, include_total=True)
    return variations_from_counts(counts, start, end, threshold, drop_null_keys)

"""Hand-made edge frames (FIXTURES.md F5) and backfill properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmur.operators.anomalies import daily_anomalies
from murmur.operators.baselines import daily_baselines
from murmur.operators.counts import daily_counts
from murmur.operators.enrich import refine_severity
from murmur.operators.repeats import repeat_complainers, repeat_summaries
from murmur.operators.resolution import aging, aging_backfill, mttr
from murmur.operators.surges import daily_surges
from murmur.operators.trends import daily_trends
from murmur.operators.variations import daily_variations
from murmur.operators.validate import hourly_gaps
from murmur.sources.tables import complaints

SCHEMA = ("sr_number string, sr_open_dttm timestamp_ntz, sr_open_dt date, sr_close_dttm timestamp_ntz, "
          "sr_status string, sr_type string, sr_sub_type string, rca string, region string, exc_id string, "
          "city string, mdn string")
D0 = dt.datetime(2026, 3, 1, 12, 0, 0)


def make(spark, rows):
    """rows: dicts with open (datetime) and optional fields."""
    out = []
    for i, r in enumerate(rows):
        o = r["open"]
        out.append((r.get("sr", f"SR-{i}"), o, o.date(), r.get("close"), r.get("status", "Closed"),
                    r.get("type", "T"), r.get("sub", "S"), r.get("rca", "R"), r.get("region", "North"),
                    r.get("exc", "E1"), r.get("city", "C1"), r.get("mdn")))
    return spark.createDataFrame(out, SCHEMA)


def day(n, hour=12):
    return dt.datetime(2026, 3, 1, hour) + dt.timedelta(days=n)


def test_baseline_window_bounds(spark):
    # target 31 March (day 30); rows on day 0 (t-30, in), day -1 (t-31, out), day 30 (t, out)
    rows = [{"open": day(0)}, {"open": day(0)}, {"open": day(-1)}, {"open": day(30)}, {"open": day(29)}]
    b = daily_baselines(daily_counts(make(spark, rows), ["Region"]), start="2026-03-31", end="2026-03-31")
    r = b.first()
    assert (r["samples_30d"], r["avg_30d"]) == (2, 1.5)                     # day 0 (2 rows), day 29 (1 row)
    assert (r["samples_7d"], r["avg_7d"], r["std_7d"]) == (1, 1.0, 0.0)     # one day: std 0
    assert r["std_30d"] == pytest.approx(0.7071067811865476)


def test_anomaly_single_date_equals_backfill(spark, tmp_dir):
    c = complaints(spark, "/root/testdata/sf0.001")
    full = daily_anomalies(c)
    for d in ["2024-01-12", "2024-01-30"]:
        one = daily_anomalies(c, d, d)
        assert sorted(one.collect()) == sorted(full.filter(F.col("anomaly_date") == d).collect())
    t1 = daily_trends(c, "2024-01-20", "2024-01-20")
    assert sorted(t1.collect()) == sorted(daily_trends(c).filter(F.col("trend_date") == "2024-01-20").collect())


def test_variation_edges(spark):
    # target Monday 2 March 2026 (one-day week); 31 March spills into March
    rows = [{"open": dt.datetime(2026, 3, 2, 9)}] * 3 + [{"open": dt.datetime(2026, 2, 23, 9)}]
    v = {r["variation_type"]: r for r in daily_variations(make(spark, rows), "2026-03-02", "2026-03-02")
         .filter(F.col("dimension") == "Total").collect()}
    assert (v["DOD"]["current_value"], v["DOD"]["previous_value"], v["DOD"]["variation_percent"]) == (3, 1, 200)
    assert (v["WOW"]["current_value"], v["WOW"]["previous_value"]) == (3.0, 1.0)
    rows = [{"open": dt.datetime(2026, 3, 31, 9)}, {"open": dt.datetime(2026, 3, 3, 9)},
            {"open": dt.datetime(2026, 3, 4, 9)}]
    v = {r["variation_type"]: r for r in daily_variations(make(spark, rows), "2026-03-31", "2026-03-31")
         .filter(F.col("dimension") == "Total").collect()}
    # previous range 1 Feb .. 3 Mar (offset 30 days spills): only 3 March has rows
    assert v["MOM"]["previous_value"] == 1.0 and v["MOM"]["current_value"] == 1.0
    assert v["DOD"]["previous_value"] == 0 and v["DOD"]["variation_percent"] == 100.0


def test_surge_first_of_month_and_gates(spark):
    rows = ([{"open": dt.datetime(2026, 4, 1, 9), "region": "A", "exc": "X", "city": "c"}] * 15
            + [{"open": dt.datetime(2026, 4, 1, 9), "region": "B", "exc": "Y", "city": "d"}] * 14)
    s = {(r["level"], r["name"]): r for r in daily_surges(make(spark, rows), "2026-04-01", "2026-04-01").collect()}
    assert s[("Total", "Total")]["mtd_surge_percent"] == 999.9 and s[("Total", "Total")]["severity"] == "CRITICAL"
    assert ("Region", "A") in s and ("Region", "B") not in s               # 15 passes, 14 does not
    assert ("Exchange", "X") in s and ("City", "c") in s
    assert s[("City", "c")]["parent"] == "A > X"


def test_repeat_thresholds_and_ties(spark):
    rows = []
    for mdn, n in [("m1", 1), ("m2", 2), ("m4", 4), ("m7", 7), ("m11", 11)]:
        for i in range(n):
            rows.append({"open": day(i % 5, 8 + i % 10), "mdn": mdn, "sub": "B" if i % 2 else "A",
                         "region": f"R{i}"})
    rows.append({"open": day(1), "mdn": ""})
    rows.append({"open": day(1), "mdn": ""})
    r = {x["mdn"]: x for x in repeat_complainers(make(spark, rows), "2026-03-10").collect()}
    assert set(r) == {"m2", "m4", "m7", "m11"}
    assert [r[m]["severity"] for m in ["m2", "m4", "m7", "m11"]] == \
        ["NORMAL REPEAT", "ALARMING", "CRITICAL", "VERY ALARMING"]
    assert r["m2"]["sr_sub_type"] == "A" and r["m2"]["region"] == "R0"      # tie A/B -> A; earliest row
    s = repeat_summaries(repeat_complainers(make(spark, rows), "2026-03-10"))
    sev = {x["severity"]: x["repeater_count"] for x in s.filter(F.col("breakdown") == "severity").collect()}
    assert sev == {"NORMAL REPEAT": 1, "ALARMING": 1, "CRITICAL": 1, "VERY ALARMING": 1}


def test_mttr_floor_and_keys(spark):
    o = dt.datetime(2026, 3, 5, 10)
    rows = [{"open": o, "close": o + dt.timedelta(seconds=299)},
            {"open": o, "close": o + dt.timedelta(seconds=300)},
            {"open": o, "close": o - dt.timedelta(seconds=60)},
            {"open": o, "close": o + dt.timedelta(hours=2), "region": ""}]
    m = {(r["dimension"], r["dimension_key"]): r for r in mttr(make(spark, rows)).collect()}
    assert m[("Total", "All")]["total_resolved_count"] == 2
    assert m[("Total", "All")]["avg_mttr_hours"] == round((300 + 7200) / 2 / 3600, 2)
    assert m[("Region", "North")]["total_resolved_count"] == 1 and ("Region", "") not in m


def test_aging_slab_boundaries_and_backfill(spark):
    ref = dt.datetime(2026, 3, 31, 23, 59, 59)
    rows = []
    for h in [24, 48, 72, 144, 240, 720, 1440]:
        rows.append({"open": ref - dt.timedelta(hours=h), "status": "Open"})
        rows.append({"open": ref - dt.timedelta(hours=h, seconds=1), "status": "Open"})
    rows.append({"open": ref - dt.timedelta(hours=100), "status": None})
    rows.append({"open": ref - dt.timedelta(hours=100), "status": "Pending", "close": ref + dt.timedelta(seconds=1)})
    rows.append({"open": ref - dt.timedelta(hours=100), "status": "Pending", "close": ref})
    df = make(spark, rows)
    a = {r["slab"]: r["count"] for r in aging(df, "2026-03-31").filter(F.col("dimension") == "Total").collect()}
    # exactly h hours falls in the slab below (strict >), one second more in the slab of h;
    # the null status is excluded; the Pending row closed one second after the day's end is open
    assert a == {"> 24 Hours": 2, "> 48 Hours": 2, "> 72 Hours": 3, "> 6 Days": 2, "> 10 Days": 2,
                 "> 30 Days": 2, "> 60 Days": 1}
    # the interval-based backfill equals the per-date computation on every date
    back = aging_backfill(df, end="2026-03-31")
    dates = [r[0] for r in df.select("sr_open_dt").distinct().collect()] + [dt.date(2026, 3, 31)]
    for d in sorted(set(dates)):
        want = sorted(aging(df, d).collect())
        got = sorted(back.filter(F.col("date") == d).select("date", "dimension", "dimension_key", "slab",
                                                            "count").collect())
        assert got == want, d


def test_severity_refinement(spark):
    def a(d, dim, key, sev):
        return (dt.date(2026, 3, d), dim, key, 10.0, 1.0, 1.0, 2.5, sev, "")
    rows = [a(1, "Type", "X", "WARNING"), a(2, "Type", "X", "WARNING"),             # persistent
            a(2, "Type", "Y", "WARNING")] + [a(2, "Region", f"R{i}", "CRITICAL") for i in range(4)] \
        + [a(3, "Type", "Z", "WARNING")] + [a(3, "Region", f"R{i}", "CRITICAL") for i in range(3)]
    df = spark.createDataFrame(rows, "anomaly_date date, dimension string, dimension_key string, metric_value double, "
                                     "baseline_avg double, baseline_std double, z_score double, severity string, "
                                     "rca_context string")
    got = {(r["anomaly_date"].day, r["dimension_key"]): r["severity"] for r in refine_severity(df).collect()}
    assert got[(1, "X")] == "WARNING" and got[(2, "X")] == "CRITICAL"
    assert got[(2, "Y")] == "CRITICAL"            # 4 Region anomalies: widespread
    assert got[(3, "Z")] == "WARNING"             # 3 is not more than 3


def test_hourly_gaps(spark):
    rows = [{"open": dt.datetime(2026, 3, 1, h)} for h in range(24) if h != 5] + \
           [{"open": dt.datetime(2026, 3, 3, h)} for h in range(24)]
    gaps = [r["hour"] for r in hourly_gaps(make(spark, rows)).orderBy("hour").collect()]
    assert gaps[0] == dt.datetime(2026, 3, 1, 5) and len(gaps) == 25       # one hour + the whole of 2 March

"""The synthetic month (FIXTURES.md F1), ingested from CSV, through every operator."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from murmur.operators.anomalies import daily_anomalies
from murmur.operators.counts import daily_counts
from murmur.operators.enrich import daily_rca_counts, enrich_anomalies, narrate
from murmur.operators.plots import trend_series
from murmur.operators.repeats import repeat_complainers
from murmur.operators.resolution import aging, mttr
from murmur.operators.surges import daily_surges
from murmur.operators.trends import daily_trends
from murmur.operators.validate import hourly_gaps, validation_issues
from murmur.operators.variations import daily_variations
from murmur.plans.daily import ingest_file, run_daily

TARGET = dt.date(2026, 1, 31)
START = dt.date(2026, 1, 1)
HEADER = ("sr_number,sr_row_id,sr_open_dttm,sr_type,region,exc_id,olt_id,rca,status,vendor,"
          "product_id,cabinet_id,sr_sub_type")


def _month_csv(path):
    n = 0
    lines = [HEADER]
    for day in range(31):
        d = START + dt.timedelta(days=day)
        last = d == TARGET
        for i in range(100 if last else 20):
            n += 1
            ts = dt.datetime(d.year, d.month, d.day, 10 + i % 10, 0, 0).strftime("%d-%b-%y %H:%M:%S")
            if i < 5:
                region, exc = "Lahore", "Cantt"
            elif i < (80 if last else 10):
                region, exc = "Karachi", "Clifton"
            else:
                region, exc = "Islamabad", "F-8"
            rca = "Power Outage" if (last and region == "Karachi") else "Fiber Cut"
            lines.append(f"SR-{1000000 + n},ROW_{n},{ts},Internet,{region},{exc},OLT1,{rca},Closed,Huawei,"
                         f"GPON,Cab1,Slow Speed")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def month(spark):
    import tempfile
    d = tempfile.mkdtemp(prefix="murmur-month-", dir="/tmp")
    csv = os.path.join(d, "month.csv")
    _month_csv(csv)
    table = os.path.join(d, "complaints_raw")
    report = ingest_file(spark, csv, table)
    return spark.read.parquet(table), report, d


def test_ingest(month):
    df, report, _ = month
    assert report["rows_read"] == 700 and report["rows_kept"] == 700 and report["inserted"] == 700
    assert df.count() == 700
    assert df.filter(F.col("sr_open_dt") == TARGET).count() == 100
    assert "olt_id" not in df.columns and df.filter(F.col("sr_status") == "Closed").count() == 700


def _rows(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def test_anomalies(month):
    df, _, _ = month
    a = daily_anomalies(df, TARGET, TARGET)
    z = _rows(a, "dimension", "dimension_key", "z_score")
    expected = {("Type", "Internet"): 80000, ("Region", "Karachi"): 70000, ("Region", "Islamabad"): 10000,
                ("Exchange", "Clifton"): 70000, ("Exchange", "F-8"): 10000, ("RCA", "Power Outage"): 75000,
                ("RCA", "Fiber Cut"): 5000, ("City", "None"): 100000}
    assert set(z) == set(expected)
    for k, v in expected.items():
        assert z[k] == pytest.approx(v)
    assert {r["severity"] for r in a.collect()} == {"CRITICAL"}


def test_enrichment_and_narrative(month):
    df, _, _ = month
    counts = daily_counts(df)
    a = daily_anomalies(df, TARGET, TARGET)
    e = enrich_anomalies(a, counts, daily_rca_counts(df))
    ctx = _rows(e, "dimension", "dimension_key", "rca_context")
    assert ctx[("Region", "Karachi")] == "Correlated with: Internet (1.00) | Probable RCA: Power Outage (100.0%)"
    assert ctx[("Type", "Internet")].endswith("Probable RCA: Power Outage (75.0%), Fiber Cut (25.0%)")
    assert ctx[("Type", "Internet")].startswith("Correlated with: Islamabad (1.00), Karachi (1.00)")
    assert ctx[("City", "None")] == ""
    ins = narrate(e).filter(F.col("title") == "Spike in Karachi (Region)").first()
    assert ins["summary"].startswith("On 2026-01-31, detected 75 complaints (Baseline: 5.0). Deviation: 70000.0σ.")
    assert "\nContext: Correlated with: Internet (1.00)" in ins["summary"]


def test_trends(month):
    df, _, _ = month
    t = daily_trends(df, TARGET, TARGET).filter(F.col("dimension_key") == "Internet")
    got = {r["window_days"]: r for r in t.collect()}
    for w, slope, r, p in [(7, 6.666667, 0.57735, 0.133975), (14, 2.0, 0.433013, 0.106908),
                           (30, 0.483871, 0.306186, 0.093890)]:
        assert got[w]["slope"] == pytest.approx(slope, abs=1e-6)
        assert got[w]["r_value"] == pytest.approx(r, abs=1e-6)
        assert got[w]["significance"] == pytest.approx(p, abs=1e-6)
        assert got[w]["trend_strength"] == pytest.approx(400.0)
        assert got[w]["trend_direction"] == "STABLE"
    lahore = daily_trends(df, TARGET, TARGET).filter(F.col("dimension_key") == "Lahore").collect()
    # constant series: slope 0, r 0, so t = 0 and p = 1 (the least-squares routine's zero-variance rule)
    assert all(r["slope"] == 0 and r["trend_direction"] == "STABLE" and r["significance"] == 1.0 for r in lahore)


def test_variations_and_surges(month):
    df, _, _ = month
    v = daily_variations(df, TARGET, TARGET).filter((F.col("dimension") == "Total")
                                                     & (F.col("variation_type") == "DOD")).first()
    assert (v["current_value"], v["previous_value"], v["variation_percent"], v["is_significant"]) == \
        (100.0, 20.0, 400.0, 1)
    s = daily_surges(df, TARGET, TARGET)
    total = s.filter(F.col("level") == "Total").first()
    assert total["wow_surge_percent"] == 400.0 and total["severity"] == "CRITICAL"
    assert total["mtd_avg"] == 20.0
    assert s.filter(F.col("name") == "Lahore").count() == 0


def test_plots_repeats_resolution_validation(month):
    df, _, _ = month
    series = trend_series(df, TARGET, 15)
    assert series.filter(F.col("level") == "total").count() == 16
    regions = {r["region"] for r in series.filter(F.col("level") == "region").collect()}
    assert regions == {"Islamabad", "Karachi", "Lahore"}
    assert repeat_complainers(df, TARGET).count() == 0
    assert mttr(df).count() == 0
    assert aging(df, TARGET).count() == 0
    gaps = hourly_gaps(df, TARGET, TARGET).orderBy("hour").collect()
    assert len(gaps) == 14 and str(gaps[0]["hour"]) == "2026-01-31 00:00:00"
    issues = [r["issue"] for r in validation_issues(df, TARGET, TARGET).collect()]
    assert any(i.startswith("Missing data for 14 hours: 2026-01-31 00:00:00") for i in issues)


def test_run_daily_replaces_by_date(spark, month):
    df, _, d = month
    out = os.path.join(d, "results")
    res = run_daily(spark, df, out, TARGET)
    a = spark.read.parquet(os.path.join(out, "daily_anomalies"))
    assert a.count() == 8
    # a rerun of the same date replaces, never appends
    run_daily(spark, df, out, TARGET)
    assert spark.read.parquet(os.path.join(out, "daily_anomalies")).count() == 8
    assert spark.read.parquet(os.path.join(out, "exec_insights")).count() == 8
    assert res["daily_trends"].count() > 0

"""Folders of unlike files, quoted text, row order; reruns of the daily pipeline."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from murmur.plans.daily import ingest_file, run_daily
from murmur.sources.csv import read_complaints_csv, read_text_complaints

HEAD = "sr_number,sr_open_dttm,region"


def write(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


def test_quotes_and_newlines(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "q"), "a.csv", 'id,complaint_text\n1,"He said ""bad, really bad"" service"\n2,"line one\nline two"\n')
    rows = {r["id"]: r["complaint_text"] for r in read_complaints_csv(spark, p).collect()}
    assert rows == {"1": 'He said "bad, really bad" service', "2": "line one\nline two"}


def test_late_latin1_byte_decides_for_its_file_only(spark, tmp_dir):
    d = os.path.join(tmp_dir, "enc")
    write(d, "01.csv", HEAD + "\n" + "".join(f"S{i},2026-01-01,North\n" for i in range(6000)) + "L,2026-01-01,Lahöre\n", "latin-1")
    write(d, "02.csv", HEAD + "\nU,2026-01-01,Lahöre\n")
    rows = {r["sr_number"]: r["region"] for r in read_complaints_csv(spark, d).filter("region like 'Lah%'").collect()}
    assert rows == {"L": "Lahöre", "U": "Lahöre"}


def test_each_file_has_its_own_separator_and_column_order(spark, tmp_dir):
    d = os.path.join(tmp_dir, "mix")
    write(d, "01.csv", "sr_number,region,exc_id\nSR-0,R,E\n")
    write(d, "02.csv", "sr_number;exc_id;region\nSR-1;E;R\n", "latin-1")
    write(d, "03.csv", "sr_number,exc_id\nSR-2,E\n")
    rows = {r["sr_number"]: (r["region"], r["exc_id"]) for r in read_complaints_csv(spark, d).collect()}
    assert rows == {"SR-0": ("R", "E"), "SR-1": ("R", "E"), "SR-2": (None, "E")}


def test_later_file_wins_whatever_its_size(spark, tmp_dir):
    d = os.path.join(tmp_dir, "order")
    write(d, "01.csv", "sr_number,sr_open_dttm,sr_type,region,exc_id\nA,2026-01-01 10:00:00,T_old,r,e\n")
    write(d, "02.csv", "sr_number,sr_open_dttm,sr_type,region,exc_id\n" + "".join(f"F{i},2026-01-01 10:00:00,x,r,e\n" for i in range(500))
          + "A,2026-01-02 10:00:00,T_mid,r,e\nA,2026-01-02 10:00:00,T_new,r,e\nbad,not a date,x,r,e\n")
    table, rejects = os.path.join(tmp_dir, "order-table"), os.path.join(tmp_dir, "order-rejects")
    report = ingest_file(spark, d, table, rejects)
    assert (report["inserted"], report["rows_rejected"]) == (501, 1)
    assert spark.read.parquet(table).filter("sr_number = 'A'").select("sr_type").collect()[0][0] == "T_new"
    assert spark.read.parquet(rejects).select("sr_number").collect()[0][0] == "bad"
    again = ingest_file(spark, d, table)
    assert (again["inserted"], again["updated"]) == (0, 501) and spark.read.parquet(table).count() == 501


def test_json_lines_and_arrays(spark, tmp_dir):
    a = write(os.path.join(tmp_dir, "j"), "a.json", '{"text": "x"}\n{"text": "y"}\n')
    b = write(os.path.join(tmp_dir, "j"), "b.json", '[{"text": "x"},\n {"text": "y"}]')
    assert all({r["text"] for r in read_text_complaints(spark, p).collect()} == {"x", "y"} for p in (a, b))


def _complaints(spark):
    """Five quiet weeks, then a jump on the last two days."""
    rows = []
    for day in range(36):
        d = dt.datetime(2026, 1, 1) + dt.timedelta(days=day)
        for k in range((5 + day % 3) if day < 34 else 40):
            rows.append((f"{day}-{k}", d + dt.timedelta(minutes=k), d.date(), "R1", "E1", "C1", "T1", "RC1", f"m{k}", None))
    return spark.createDataFrame(rows, "sr_number string, sr_open_dttm timestamp_ntz, sr_open_dt date, region string, "
                                 "exc_id string, city string, sr_type string, rca string, mdn string, "
                                 "sr_close_dttm timestamp_ntz").withColumns(
        {"sr_sub_type": F.lit("S"), "cabinet_id": F.lit("cab"), "dp_id": F.lit("dp"), "sr_status": F.lit("Open")})


def _stored(spark, out, name, cols):
    return sorted(tuple(str(v) for v in r) for r in spark.read.parquet(f"{out}/{name}").select(*cols).collect())


def test_day_by_day_equals_range_and_dimension_rerun_keeps_others(spark, tmp_dir):
    c = _complaints(spark)
    first, last = "2026-02-04", "2026-02-05"
    a, b = os.path.join(tmp_dir, "range"), os.path.join(tmp_dir, "days")
    run_daily(spark, c, a, first, last)
    run_daily(spark, c, b, first)
    run_daily(spark, c, b, last)
    cols = ["anomaly_date", "dimension", "dimension_key", "severity"]
    assert _stored(spark, a, "daily_anomalies", cols) == _stored(spark, b, "daily_anomalies", cols)
    assert any(r[0] == last and r[3] == "CRITICAL" for r in _stored(spark, a, "daily_anomalies", cols))
    for name in ("validation_issues", "repeat_complainers", "exec_insights"):
        assert spark.read.parquet(f"{a}/{name}").columns
    trends = ["trend_date", "dimension", "dimension_key", "window_days"]
    before = _stored(spark, a, "daily_trends", trends), _stored(spark, a, "exec_insights", ["title", "summary"])
    run_daily(spark, c, a, first, last, dimensions=["Region"])
    assert before == (_stored(spark, a, "daily_trends", trends), _stored(spark, a, "exec_insights", ["title", "summary"]))


def test_date_without_rows_has_trends_and_baselines(spark):
    from murmur.operators.baselines import daily_baselines
    from murmur.operators.counts import daily_counts
    from murmur.operators.trends import daily_trends
    c = _complaints(spark)
    assert daily_trends(c, "2026-02-07", "2026-02-07").count() > 0
    assert daily_baselines(daily_counts(c), start="2026-02-07", end="2026-02-07").count() > 0

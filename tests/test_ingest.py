"""Ingestion edge cases (FIXTURES.md F2, F5): formats, headers, encodings, upsert, replace."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from murmur.constants import DATE_FORMATS, DATETIME_FORMATS
from murmur.functions.dates import parse_datetime_multi, pattern_shape, text_shape
from murmur.operators.ingest import SchemaError, coerce_complaints, ingest_report, normalize_headers, parse_dates
from murmur.plans.daily import ingest_file
from murmur.sources.csv import read_complaints_csv, sniff_separator
from murmur.sources.sinks import delete_date_range, replace_by_date


@pytest.mark.parametrize("text,expected", [
    ("31-01-2026 10:15:30", dt.datetime(2026, 1, 31, 10, 15, 30)),
    ("31-01-2026 10:15", dt.datetime(2026, 1, 31, 10, 15)),
    ("05/04/2026 10:00", dt.datetime(2026, 4, 5, 10, 0)),          # no seconds: day first
    ("05/04/2026 10:00:00", dt.datetime(2026, 5, 4, 10, 0)),       # seconds: month first
    ("31-01-26 10:15:30", dt.datetime(2026, 1, 31, 10, 15, 30)),
    ("01-01-75 10:00", dt.datetime(1975, 1, 1, 10, 0)),            # two-digit year above 68
    ("31-Jan-26 10:15:30", dt.datetime(2026, 1, 31, 10, 15, 30)),
    ("31-JAN-26 10:15", dt.datetime(2026, 1, 31, 10, 15)),
    ("2026-01-31 10:15:30", dt.datetime(2026, 1, 31, 10, 15, 30)),
    ("2026/01/31 10:15:30", dt.datetime(2026, 1, 31, 10, 15, 30)),
    ("2026-01-31T10:15:30", dt.datetime(2026, 1, 31, 10, 15, 30)),
    ("31-Jan-2026 10:15:30", dt.datetime(2026, 1, 31, 10, 15, 30)),
    ("1/31/2026 10:15:30 PM", dt.datetime(2026, 1, 31, 22, 15, 30)),
    ("2026-01-31 10:15:30 AM", dt.datetime(2026, 1, 31, 10, 15, 30)),
    ("garbage", None),
])
def test_datetime_formats(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(parse_datetime_multi(F.col("s"))).first()[0] == expected


def _write(path, text, encoding="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


HDR_ROWS = "SR-1{s}ROW_1{s}31-Jan-26 10:00:00{s}Internet{s}Lahore{s}Cantt{s}P1\n"


@pytest.mark.parametrize("sep,encoding,bom", [(",", "utf-8", False), (";", "utf-8", True), ("\t", "latin1", False),
                                              ("|", "utf-16", False)])
def test_headers_separators_encodings(spark, tmp_dir, sep, encoding, bom):
    header = sep.join([" SR Number ", "Record_ID", "Date", "Category", "Zone", "Exchange", "SR_PRIO_CD"]) + "\n"
    body = HDR_ROWS.format(s=sep).replace("Lahore", "Lahöre")
    path = os.path.join(tmp_dir, "f.csv")
    data = header + body
    raw = (b"\xef\xbb\xbf" if bom else b"") + data.encode(encoding)
    with open(path, "wb") as f:
        f.write(raw)
    df = read_complaints_csv(spark, path)
    c, rejects, supplied = coerce_complaints(df)
    row = c.first()
    assert row["sr_number"] == "SR-1" and row["sr_row_id"] == "ROW_1" and row["sr_type"] == "Internet"
    assert row["region"] == "Lahöre" and row["exc_id"] == "Cantt" and row["priority"] == "P1"
    assert row["sr_open_dttm"] == dt.datetime(2026, 1, 31, 10, 0) and row["sr_open_dt"] == dt.date(2026, 1, 31)
    assert rejects.count() == 0 and "sr_open_dttm" in supplied


def test_missing_sr_number_is_rejected_before_filling(spark):
    cols = ["sr_row_id", "sr_open_dttm", "sr_type", "region", "exc_id", "olt_id", "rca", "status", "vendor",
            "product_id"]
    df = spark.createDataFrame([tuple("x" for _ in cols)], ", ".join(f"{c} string" for c in cols))
    with pytest.raises(SchemaError) as e:
        coerce_complaints(df)
    assert e.value.diagnostics["missing"] == ["sr_number"]


def test_normalize_headers(spark):
    df = spark.createDataFrame([(1, 2)], "` SR Number ` int, `Open Date` int")
    assert normalize_headers(df).columns == ["sr_number", "open_date"]


def test_upsert_semantics(spark, tmp_dir):
    table = os.path.join(tmp_dir, "complaints")
    a = os.path.join(tmp_dir, "a.csv")
    _write(a, "sr_number,sr_open_dttm,sr_type,region,exc_id,rca,city\n"
              "SR-1,01-01-2026 10:00:00,T1,R1,E1,Fiber,C1\n"
              "SR-2,01-01-2026 11:00:00,T1,R1,E1,Fiber,C2\n"
              "SR-3,02-01-2026 11:00:00,T2,R2,E2,Power,C3\n")
    rep = ingest_file(spark, a, table)
    assert (rep["inserted"], rep["updated"]) == (3, 0)
    b = os.path.join(tmp_dir, "b.csv")
    # SR-1 twice (the later row wins), rca supplied empty (null overwrites), city absent (kept);
    # SR-3 moves to another day (its old partition must be emptied); SR-4 is new
    _write(b, "sr_number,sr_open_dttm,sr_type,region,exc_id,rca\n"
              "SR-1,01-01-2026 10:00:00,T9,R1,E1,Fiber\n"
              "SR-1,01-01-2026 10:00:00,T8,R1,E1,\n"
              "SR-3,05-01-2026 09:00:00,T2,R2,E2,Power\n"
              "SR-4,05-01-2026 12:00:00,T4,R4,E4,Other\n")
    rep = ingest_file(spark, b, table)
    assert (rep["inserted"], rep["updated"]) == (1, 2)
    rows = {r["sr_number"]: r for r in spark.read.parquet(table).collect()}
    assert set(rows) == {"SR-1", "SR-2", "SR-3", "SR-4"}
    assert rows["SR-1"]["sr_type"] == "T8" and rows["SR-1"]["rca"] is None and rows["SR-1"]["city"] == "C1"
    assert rows["SR-2"]["sr_type"] == "T1"
    assert rows["SR-3"]["sr_open_dt"] == dt.date(2026, 1, 5) and rows["SR-4"]["city"] is None
    # upsert again: idempotent
    ingest_file(spark, b, table)
    assert spark.read.parquet(table).count() == 4


def test_replace_by_date_and_range_delete(spark, tmp_dir):
    t = os.path.join(tmp_dir, "res")
    df = spark.createDataFrame([(dt.date(2026, 1, 1), "Region", 1.0), (dt.date(2026, 1, 1), "Type", 2.0),
                                (dt.date(2026, 1, 2), "Region", 3.0)], "d date, dimension string, v double")
    replace_by_date(spark, df, t, "d", [dt.date(2026, 1, 1), dt.date(2026, 1, 2)])
    assert spark.read.parquet(t).count() == 3
    # rerun for 1 Jan / Region only, with no rows: clears that pair, keeps Type and 2 Jan
    replace_by_date(spark, df.limit(0), t, "d", [dt.date(2026, 1, 1)], dimensions=["Region"])
    assert sorted((str(r["d"]), r["dimension"]) for r in spark.read.parquet(t).collect()) == \
        [("2026-01-01", "Type"), ("2026-01-02", "Region")]
    out = delete_date_range(spark, {"res": t}, "2026-01-02", "2026-01-31").collect()
    assert [(r["table"], r["removed"]) for r in out] == [("res", 1)]
    assert spark.read.parquet(t).count() == 1


def test_baselines_roundtrip_and_cli_text(spark, tmp_dir):
    from murmur.operators.anomalies import anomalies_from_baselines, anomalies_from_counts
    from murmur.operators.baselines import daily_baselines
    from murmur.operators.counts import daily_counts
    from murmur.sources.sinks import read_baselines, write_baselines
    from murmur.sources.tables import complaints
    c = complaints(spark, "/root/testdata/sf0.001")
    counts = daily_counts(c)
    path = os.path.join(tmp_dir, "baselines")
    assert read_baselines(spark, path) is None
    write_baselines(daily_baselines(counts), path)
    b = read_baselines(spark, path)
    via_store = anomalies_from_baselines(counts, b)
    direct = anomalies_from_counts(counts)
    # stored baselines exist for dates with history; the first date has none in either form
    key = lambda r: (str(r["anomaly_date"]), r["dimension"], r["dimension_key"])
    assert sorted(map(key, via_store.collect())) == sorted(map(key, direct.collect()))
    from murmur.cli import main
    src = os.path.join(tmp_dir, "texts.csv")
    _write(src, "complaint_id,text\n1,This product is broken\n2,Great customer service!\n")
    main(["text", "--input", src, "--output", os.path.join(tmp_dir, "out"), "--generate-report"])
    out = spark.read.option("header", True).csv(os.path.join(tmp_dir, "out", "analyzed"))
    assert sorted(r["category"] for r in out.collect()) == ["Customer Service", "Product Quality"]


@pytest.mark.parametrize("header, sep", [
    ('sr_number;sr_open_dttm;"region, zone"', ";"), ('sr_number,sr_open_dttm,"a; b; c; d; e"', ","), ("SR Number|Open Date|Zone", "|"),
    ("sr_number\tsr_open_dttm", "\t"), ("id,complaint_text", ","), ("one", ","), ("", ","), ('x;y;"a,b,c"', ";")])
def test_separator_of_the_parsed_header(header, sep):
    assert sniff_separator(header) == sep


def test_every_row_is_kept_or_rejected_with_a_reason(spark):
    opened = "02-01-2026 10:00:00"
    raw = spark.createDataFrame([(None, opened, "r", "e", "t"), ("  ", opened, "r", "e", "t"), ("A1", "nonsense", "r", "e", "t"),
                                 (None, None, "r", "e", "t"), ("A2", opened, "r", "e", "t")],
                                "sr_number string, sr_open_dttm string, region string, exc_id string, sr_type string")
    kept, rejects, _ = coerce_complaints(raw)
    assert [r["sr_number"] for r in kept.collect()] == ["A2"]
    assert sorted((r["sr_number"] or "", r["raw_sr_open_dttm"] or "", r["reason"]) for r in rejects.collect()) == [
        ("", "", "open time not parsed"), ("", opened, "no sr_number"), ("  ", opened, "no sr_number"),
        ("A1", "nonsense", "open time not parsed")]
    report = ingest_report(parse_dates(raw)).first()
    assert (report["rows_read"], report["rows_kept"], report["rows_rejected"]) == (5, 1, 4)


def test_a_text_is_tried_with_the_patterns_of_its_shape(spark):
    by_shape = {}
    for p in DATETIME_FORMATS:
        by_shape.setdefault(pattern_shape(p), []).append(p)
    assert max(map(len, by_shape.values())) <= 2
    shapes = spark.createDataFrame([("05-Jan-2026 1:02:03",), ("2026-01-05T10:00:00",), ("1/2/26 3:04:05",), ("001/2/2026 3:04",),
                                    ("12345",), ("",), (None,)], "s string").select(text_shape(F.col("s"))).collect()
    assert [r[0] for r in shapes] == ["0-a-4 0:0:0", "4-0-0a0:0:0", "0/0/0 0:0:0", "00/0/4 0:0", "40", "", None]


def test_parsed_values_are_computed_once(spark):
    raw = spark.createDataFrame([("A", "02-01-2026 10:00:00", "x", "02-01-2026", "r", "e", "t")],
                                "sr_number string, sr_open_dttm string, sr_close_dttm string, sr_open_dt string, region string, exc_id string, sr_type string")
    kept, _, _ = coerce_complaints(raw)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    patterns = [*DATETIME_FORMATS, *DATETIME_FORMATS, *DATE_FORMATS]         # two-digit years name their value twice more
    assert plan.count("gettimestamp") == len(patterns) + 2 * sum("yyyy" not in p for p in patterns)

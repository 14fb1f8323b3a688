"""Batches through the journal: results equal a full run, interrupted moves are finished, nothing is applied twice."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from murmur.operators.anomalies import asof_baselines
from murmur.operators.counts import daily_counts
from murmur.operators.resolution import aging, aging_backfill, mttr
from murmur.plans import incremental
from murmur.plans.daily import run_daily
from murmur.plans.queries_state import change_batch, split_base
from murmur.sources.tables import complaints

SF = "/root/testdata/sf0.001"
START, END = "2024-01-18", "2024-01-22"


def rows(df, *drop):
    cols = sorted(set(df.columns) - set(drop))
    return sorted(df.select(*cols).collect(), key=str)


def test_batches_equal_a_full_run(spark, tmp_dir):
    root, out, full = (os.path.join(tmp_dir, x) for x in ("state", "out", "full"))
    view = complaints(spark, SF)
    supplied = [c for c in view.columns if c not in ("rca", "city")]
    first = incremental.apply_batch(spark, root, split_base(view), supplied)
    run_daily(spark, spark.read.parquet(f"{root}/complaints"), out, START, END)
    second = incremental.apply_batch(spark, root, change_batch(view), supplied)
    assert first["updated"] == 0 and second["inserted"] > 0 and second["updated"] > 0
    replaced = incremental.refresh_results(spark, root, out, second["images"], START, END)
    assert all(replaced.values())
    now = spark.read.parquet(f"{root}/complaints")
    run_daily(spark, now, full, START, END)
    for name in [*replaced, "exec_insights"]:
        got, want = (spark.read.parquet(f"{d}/{name}") for d in (out, full))
        assert rows(got) == rows(want), name
    counts = spark.read.parquet(f"{root}/counts").select("dimension", "dimension_key", "day", "n")
    assert rows(counts) == rows(daily_counts(now, include_total=True).select(*counts.columns))
    # the same batch again changes nothing: no images, no dates
    again = incremental.apply_batch(spark, root, change_batch(view), supplied)
    assert again["inserted"] == 0 and spark.read.parquet(again["images"]).count() == 0
    assert not any(incremental.refresh_results(spark, root, out, again["images"], START, END).values())


def test_interrupted_batch_is_finished(spark, tmp_dir, monkeypatch):
    root = os.path.join(tmp_dir, "state")
    schema = "sr_number string, sr_open_dttm timestamp_ntz, sr_open_dt date, sr_close_dttm timestamp_ntz, sr_status string, " \
             "sr_type string, rca string, region string, exc_id string, city string"
    row = lambda k, d, city: (k, dt.datetime(2026, 1, d, 9), dt.date(2026, 1, d), None, "Open", "T", None, "R", "E", city)
    a = spark.createDataFrame([row("A", 1, "c1"), row("B", 2, "c1")], schema)
    b = spark.createDataFrame([row("A", 3, None), row("C", 1, None)], schema)         # A moves, C is new
    supplied = [c for c in a.columns if c != "city"]
    incremental.apply_batch(spark, root, a, supplied)
    real, calls = incremental.swap_staged, []

    def fails(session, staged, table):
        if calls:
            raise OSError("lost")
        calls.append(table)
        real(session, staged, table)

    monkeypatch.setattr(incremental, "swap_staged", fails)
    with pytest.raises(OSError):
        incremental.apply_batch(spark, root, b, supplied)
    monkeypatch.setattr(incremental, "swap_staged", real)
    incremental.finish_batch(spark, root)
    now = spark.read.parquet(f"{root}/complaints")
    assert {(r["sr_number"], r["sr_open_dt"].day, r["city"]) for r in now.collect()} == {("A", 3, "c1"), ("B", 2, "c1"), ("C", 1, None)}
    counts = spark.read.parquet(f"{root}/counts").select("dimension", "dimension_key", "day", "n")
    assert rows(counts) == rows(daily_counts(now, include_total=True).select(*counts.columns))
    assert not os.path.exists(f"{root}/_journal") and not [f for f in os.listdir(root) if ".staged-" in f]


def test_interrupted_swap_keeps_every_row(spark, tmp_dir, monkeypatch):
    from murmur.sources import sinks
    table = os.path.join(tmp_dir, "t")
    day = lambda d: dt.date(2026, 1, d)
    make = lambda *r: spark.createDataFrame(list(r), "day date, n int")
    sinks.write_partitioned(make((day(1), 1), (day(2), 2), (day(3), 3)), table, ["day"])
    staged = sinks.stage_partitions(spark, make((day(2), 20), (day(4), 40)), table, ["day"], {"day=2026-01-01", "day=2026-01-02"})
    real, moves = sinks._move, []

    def fails(fs, path, source, target):
        if len(moves) == 1:
            raise OSError("lost")
        moves.append(source)
        real(fs, path, source, target)

    monkeypatch.setattr(sinks, "_move", fails)
    with pytest.raises(OSError):
        sinks.swap_staged(spark, staged, table)
    monkeypatch.setattr(sinks, "_move", real)
    for _ in range(2):                                                  # a second call finds nothing to do
        sinks.swap_staged(spark, staged, table)
    assert rows(spark.read.parquet(table)) == rows(make((day(2), 20), (day(3), 3), (day(4), 40)))


def test_ageing_of_a_range_and_part_seconds(spark):
    ref = dt.datetime(2026, 3, 31, 23, 59, 59)
    out = []
    for i, h in enumerate([24, 47, 100, 500, 1000, 1440, 2000]):
        o = ref - dt.timedelta(hours=h, microseconds=-500_000 if i % 2 else 1)
        out.append((f"S{i}", o, o.date(), None if i % 3 else ref + dt.timedelta(microseconds=1), "Open", "R", "E", "C"))
    df = spark.createDataFrame(out, "sr_number string, sr_open_dttm timestamp_ntz, sr_open_dt date, sr_close_dttm timestamp_ntz, "
                                    "sr_status string, region string, exc_id string, city string")
    got = aging_backfill(df, "2026-03-29", "2026-04-02")
    for d in ("2026-03-29", "2026-03-30", "2026-03-31", "2026-04-01", "2026-04-02"):
        assert rows(got.filter(F.col("date") == d)) == rows(aging(df, d)), d
    assert rows(mttr(df, "2026-03-31", "2026-03-31")) == rows(mttr(df).filter("date = '2026-03-31'"))
    assert mttr(df, "2026-04-01").count() == 0 and aging_backfill(df.limit(0), "2026-03-29", "2026-04-02").count() == 0


def test_asof_baselines(spark):
    day = lambda d: dt.date(2026, 1, d)
    held = spark.createDataFrame([("T", "a", day(1), 1.0, 0.1), ("T", "a", day(5), 5.0, 0.5), ("T", None, day(1), 9.0, 0.9)],
                                 "dimension string, dimension_key string, as_of date, avg_30d double, std_30d double")
    asked = spark.createDataFrame([("T", "a", day(4), 7), ("T", "a", day(5), 8), ("T", "a", dt.date(2025, 12, 31), 1),
                                   ("T", "b", day(5), 2), ("T", None, day(5), 3)], "dimension string, dimension_key string, day date, n long")
    got = {(r["dimension_key"], r["n"]): r["avg"] for r in asof_baselines(asked, held).collect()}
    assert got == {("a", 7): 1.0, ("a", 8): 5.0, ("a", 1): None, ("b", 2): None, (None, 3): None}
    young = {(r["dimension_key"], r["n"]): r["avg"] for r in asof_baselines(asked, held, max_age_days=2).collect()}
    assert young[("a", 7)] is None and young[("a", 8)] == 5.0

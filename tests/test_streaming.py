"""Structured Streaming: counts with a watermark equal the batch counts; the
drop-folder ingest upserts like the batch path."""

import datetime as dt
import os

from pyspark.sql import functions as F

from murmur.operators.counts import daily_counts
from murmur.sources.tables import complaints
from murmur.streaming.counts import stream_daily_counts
from murmur.streaming.final_counts import apply_counts_batch, open_counts, read_final, read_late, read_log, stream_final_counts
from murmur.streaming.ingest import ingest_stream


def test_stream_counts_equal_batch(spark, tmp_dir):
    c = complaints(spark, "/root/testdata/sf0.001")
    src = os.path.join(tmp_dir, "src")
    c.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(c.schema).parquet(src)
    (stream_daily_counts(stream, lateness="3650 days").writeStream.outputMode("update").format("memory")
     .queryName("murmur_counts_t").option("checkpointLocation", os.path.join(tmp_dir, "ckpt"))
     .trigger(availableNow=True).start().awaitTermination())
    got = spark.sql("SELECT * FROM murmur_counts_t")
    want = daily_counts(c, include_total=True)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(got.collect(), key=key) == \
        sorted(want.select("dimension", "dimension_key", "day", "n").collect(), key=key)


def test_ingest_stream(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    os.makedirs(inbox)
    cols = ["sr_number", "sr_open_dttm", "sr_type", "region", "exc_id"]
    with open(os.path.join(inbox, "a.csv"), "w") as f:
        f.write(",".join(cols) + "\nSR-1,01-01-2026 10:00:00,T,R,E\nSR-2,02-01-2026 10:00:00,T,R,E\n")
    table = os.path.join(tmp_dir, "table")
    q = ingest_stream(spark, inbox, table, os.path.join(tmp_dir, "ck"), cols)
    q.awaitTermination()
    with open(os.path.join(inbox, "b.csv"), "w") as f:
        f.write(",".join(cols) + "\nSR-2,02-01-2026 10:00:00,T2,R,E\nSR-3,03-01-2026 10:00:00,T,R,E\n")
    q = ingest_stream(spark, inbox, table, os.path.join(tmp_dir, "ck"), cols)
    q.awaitTermination()
    rows = {r["sr_number"]: r["sr_type"] for r in spark.read.parquet(table).collect()}
    assert rows == {"SR-1": "T", "SR-2": "T2", "SR-3": "T"}
    assert spark.read.parquet(table).filter(F.col("sr_open_dt").isNull()).count() == 0


def test_repeated_batch_writes_its_rejects_once(spark, tmp_dir):
    inbox, rejects = os.path.join(tmp_dir, "inbox"), os.path.join(tmp_dir, "rejects")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "a.csv"), "w") as f:
        f.write("sr_number,sr_open_dttm,sr_type,region,exc_id\nSR-1,01-01-2026 10:00:00,T,R,E\nSR-2,never,T,R,E\n")
    for attempt in range(2):            # a lost commit: the same batch of a fresh checkpoint
        ingest_stream(spark, inbox, os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, f"ck{attempt}"), rejects_path=rejects).awaitTermination()
    assert [r["sr_number"] for r in spark.read.parquet(rejects).collect()] == ["SR-2"]


SCHEMA = "sr_number string, sr_open_dttm timestamp_ntz, sr_type string, region string, exc_id string, city string, rca string"


def rows(spark, *items):
    return spark.createDataFrame([(n, t and dt.datetime.fromisoformat(t), "T", None, "E", "C", "x") for n, t in items], SCHEMA)


BATCHES = [
    [("A", "2026-01-01 10:00"), ("B", "2026-01-02 10:00"), ("B", "2026-01-02 09:00"), (None, "2026-01-02 11:00"), (None, "2026-01-02 11:00")],
    [("A", "2026-01-01 12:00"), ("C", "2026-01-05 10:00"), ("D", None)],            # A again, its day still open
    [],
    [("E", "2026-01-02 23:59"), ("F", "2026-01-03 00:00"), ("A", "2026-01-04 00:00")],   # late by more; by less; A's day is closed
    [("G", "2026-01-09 10:00")],
]


def state(spark, root):
    def table(df):
        return sorted(map(str, df.collect()))
    return (table(read_final(spark, root).filter("dimension = 'Total'").select("day", "n")),
            sorted((r["sr_number"], r["reason"], r["batch"]) for r in read_late(spark, root).collect()),
            sorted(tuple(r) for r in read_log(spark, root).select("batch", "rows_read", "rows_late", "rows_accepted", "rows_duplicate").collect()),
            table(open_counts(spark, root)))


def test_every_row_ends_in_one_place_and_batches_can_be_repeated(spark, tmp_dir):
    once, again = os.path.join(tmp_dir, "once"), os.path.join(tmp_dir, "again")
    for i, b in enumerate(BATCHES):
        apply_counts_batch(rows(spark, *b), i, once)
        apply_counts_batch(rows(spark, *b), i, again)
        apply_counts_batch(rows(spark, *b), i, again)
    final, late, log, running = state(spark, once)
    assert state(spark, again) == (final, late, log, running)
    assert late == [("D", "no open time", 1), ("E", "late", 3)]
    assert log == [(0, 5, 0, 4, 1), (1, 3, 1, 1, 1), (2, 0, 0, 0, 0), (3, 3, 1, 2, 0), (4, 1, 0, 1, 0)]
    assert final == ["Row(day=datetime.date(2026, 1, %d), n=%d)" % x for x in ((1, 1), (2, 3), (3, 1), (4, 1), (5, 1))]
    assert {r["n"] for r in open_counts(spark, once).collect()} == {1}


def test_restarted_stream_goes_on(spark, tmp_dir):
    src, root, check = (os.path.join(tmp_dir, n) for n in ("src", "root", "check"))
    for i, b in enumerate(b for b in BATCHES if b):
        rows(spark, *b).write.mode("append").parquet(src)
        stream_final_counts(spark.readStream.schema(SCHEMA).parquet(src), root, check).awaitTermination()
    assert sorted(r["sr_number"] for r in read_late(spark, root).collect()) == ["D", "E"]
    assert read_log(spark, root).agg(F.sum("rows_read")).first()[0] == sum(map(len, BATCHES))


def test_stream_without_rows(spark, tmp_dir):
    root = os.path.join(tmp_dir, "none")
    assert read_final(spark, root).count() == 0 and open_counts(spark, root).count() == 0
    apply_counts_batch(rows(spark), 0, root)
    assert read_final(spark, root).count() == 0 and open_counts(spark, root).count() == 0 and read_late(spark, root).count() == 0

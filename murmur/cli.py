"""Command line (spark-submit) entry points.

  spark-submit murmur/cli.py daily --table T --out O --date 2026-01-31 [--end D] [--file CSV] [--baseline B]
  spark-submit murmur/cli.py text --input complaints.csv|.json --output DIR [--generate-report]

``daily`` optionally ingests a CSV into the complaint table (upsert), then
computes and stores every result table for the date range; ``--baseline``
also stores the baselines.  ``text`` analyses a file of complaint texts.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import json

from pyspark.sql import SparkSession


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="murmur")
    sub = p.add_subparsers(dest="cmd", required=True)
    d = sub.add_parser("daily")
    d.add_argument("--table", required=True, help="complaint table (Parquet, partitioned by sr_open_dt)")
    d.add_argument("--out", required=True, help="folder of the result tables")
    d.add_argument("--date", default=str(_dt.date.today() - _dt.timedelta(days=1)))
    d.add_argument("--end")
    d.add_argument("--file", help="CSV file or folder to ingest first")
    d.add_argument("--no-ingest", action="store_true", help="do not ingest the file, only analyse the table")
    d.add_argument("--dimensions", nargs="+", help="dimensions to analyse (default: all)")
    d.add_argument("--baseline", help="also store baselines at this path")
    t = sub.add_parser("text")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--generate-report", action="store_true")
    a = p.parse_args(argv)

    from murmur.session import configure
    spark = configure(SparkSession.builder.appName("murmur").getOrCreate())
    if a.cmd == "daily":
        from murmur.operators.baselines import daily_baselines
        from murmur.operators.counts import daily_counts
        from murmur.plans.daily import cleanup, ingest_file, run_daily
        from murmur.sources.sinks import write_baselines
        if a.file and not a.no_ingest:
            print(json.dumps(ingest_file(spark, a.file, a.table), default=str))
        complaints = spark.read.parquet(a.table)
        res = run_daily(spark, complaints, a.out, a.date, a.end, a.dimensions)
        if a.baseline:
            write_baselines(daily_baselines(daily_counts(complaints, a.dimensions, lookback_days=30, start=a.date,
                                                         end=a.end or a.date), start=a.date, end=a.end or a.date),
                            a.baseline)
        cleanup(spark, res)
    else:
        from pyspark.sql import functions as F

        from murmur.operators.text import analyze_complaints, distributions, format_report, load_text_dedup
        from murmur.sources.csv import read_text_complaints
        from murmur.sources.sinks import export_csv
        raw = read_text_complaints(spark, a.input)
        if "complaint_id" not in raw.columns:
            raw = raw.withColumn("complaint_id", F.monotonically_increasing_id())
        analyzed = analyze_complaints(load_text_dedup(raw))
        export_csv(analyzed, f"{a.output}/analyzed")
        export_csv(distributions(analyzed), f"{a.output}/distributions")
        if a.generate_report:
            export_csv(format_report(analyzed), f"{a.output}/report")


if __name__ == "__main__":
    main()

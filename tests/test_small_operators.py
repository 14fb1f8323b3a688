"""Operators not covered elsewhere: lexicon polarity, lemmas, stop words, filters, orderings."""

import datetime as dt

from pyspark.sql import functions as F

from murmur.operators.enrich import filter_insights
from murmur.operators.resolution import mttr_breakdown, mttr_trend, slab_rank
from murmur.operators.surges import surge_table
from murmur.operators.text import filter_text, lemmatize, lexicon_polarity, preprocess, remove_stopwords


def test_lexicon_polarity_lemmas_stopwords(spark):
    texts = spark.createDataFrame([(1, "Great service, awful app"), (2, "Nothing here"), (3, "Great great!")],
                                  "id long, t string")
    lex = spark.createDataFrame([("great", 0.8), ("awful", -1.0)], "term string, weight double")
    p = {r["id"]: (r["polarity"], r["sentiment"]) for r in lexicon_polarity(texts, "id", "t", lex).collect()}
    assert p == {1: (-0.1, "neutral"), 2: (0.0, "neutral"), 3: (0.8, "positive")}
    lem = spark.createDataFrame([("services", "service"), ("apps", "app")], "form string, lemma string")
    d = spark.createDataFrame([(1, "many services and apps")], "id long, t string")
    assert lemmatize(d, "t", "id", lem).first()["t"] == "many service and app"
    assert lemmatize(d, "t", "id", None).first()["t"] == "many services and apps"
    s = spark.createDataFrame([("The product IS broken",)], "t string")
    assert s.select(remove_stopwords(F.col("t"), ["the", "is"])).first()[0] == "product broken"


def test_filters_and_orderings(spark):
    a = spark.createDataFrame([(1, "negative", "Other"), (2, "positive", "Billing/Payment")],
                              "complaint_id long, sentiment string, category string")
    assert [r[0] for r in filter_text(a, sentiments=["negative"]).collect()] == [1]
    assert [r[0] for r in filter_text(a, categories=["Billing/Payment"]).collect()] == [2]
    ins = spark.createDataFrame([(dt.datetime(2026, 1, 1), "a", 3.0), (dt.datetime(2026, 1, 3), "b", 2.0),
                                 (dt.datetime(2026, 1, 3), "c", 9.0)], "created_at timestamp_ntz, title string, "
                                                                       "z_score double")
    assert [r["title"] for r in filter_insights(ins, "2026-01-02").collect()] == ["c", "b"]
    slabs = spark.createDataFrame([("> 24 Hours",), ("> 60 Days",)], "slab string")
    assert [r[0] for r in slabs.select(slab_rank(F.col("slab"))).collect()] == [0, 6]
    m = spark.createDataFrame([(dt.date(2026, 1, d), dim, k, h, 1) for d, dim, k, h in
                               [(1, "Total", "All", 2.0), (20, "Total", "All", 3.0), (20, "Region", "A", 1.0),
                                (20, "Region", "B", 5.0)]],
                              "date date, dimension string, dimension_key string, avg_mttr_hours double, "
                              "total_resolved_count int")
    assert [r["date"].day for r in mttr_trend(m, "2026-01-20", 10).collect()] == [20]
    assert [r["dimension_key"] for r in mttr_breakdown(m, "Region").collect()] == ["B", "A"]
    s = spark.createDataFrame([(dt.date(2026, 1, 1), "Total", "Total", 30.0, "ALARMING"),
                               (dt.date(2026, 1, 1), "Region", "A", 20.0, "CRITICAL"),
                               (dt.date(2026, 1, 1), "Region", "B", 80.0, "CRITICAL")],
                              "surge_date date, level string, name string, max_surge_percent double, severity string")
    assert [r["name"] for r in surge_table(s).collect()] == ["B", "A", "Total"]


def test_texts_of_rows_that_share_an_id(spark):
    d = spark.createDataFrame([(1, "many Apps"), (1, "good apps, apps apps"), (None, "many Apps"), (2, None), (3, "")], "id long, t string")
    lem = spark.createDataFrame([("apps", "app"), ("apps", "zapp"), ("unused", "x")], "form string, lemma string")
    got = sorted((str(r["id"]), str(r["t"]), r["cleaned_text"]) for r in preprocess(d, "t", ["many"], lem).collect())
    assert got == [("1", "good apps, apps apps", "good apps, app app"), ("1", "many Apps", "app"), ("2", "None", ""),
                   ("3", "", ""), ("None", "many Apps", "app")]
    lex = spark.createDataFrame([("good", 1.0), ("many", -1.0)], "term string, weight double")
    p = sorted((str(r["id"]), r["polarity"]) for r in lexicon_polarity(d, "id", "t", lex).collect())
    assert p == [("1", -1.0), ("1", 1.0), ("2", 0.0), ("3", 0.0), ("None", -1.0)]


def test_schema_issues_are_rows(spark):
    from murmur.operators.validate import schema_issues
    a = spark.createDataFrame([], "x int, y int")
    tables = {"raw": a, "old": a, "gone": None}
    assert schema_issues(tables, {"raw": ["x", "z"], "gone": ["x"]}, ["old", "never"]) == [
        ("gone", "missing table"), ("raw", "missing column z"), ("old", "retired table still exists")]


def test_report_without_keywords(spark):
    from murmur.operators.text import format_report
    df = spark.createDataFrame([(1, None, "unknown", 0.0, "Other", "low", [])],
                               "complaint_id int, original_text string, sentiment string, sentiment_score double, category string, "
                               "priority string, keywords array<string>")
    assert format_report(df).first()["report"].endswith("Priority Level: LOW\nKey Topics: None identified")


def test_daily_command_without_ingest_for_one_dimension(spark, tmp_dir):
    import os

    from murmur import cli
    from murmur.sources.tables import complaints
    table, out = os.path.join(tmp_dir, "table"), os.path.join(tmp_dir, "out")
    view = complaints(spark, "/root/testdata/sf0.001")
    day = str(view.agg({"sr_open_dt": "max"}).first()[0])
    view.write.partitionBy("sr_open_dt").parquet(table)
    cli.main(["daily", "--table", table, "--out", out, "--date", day, "--file", "/no/such/file.csv", "--no-ingest", "--dimensions", "Region"])
    dims = {r[0] for r in spark.read.parquet(f"{out}/daily_variations").select("dimension").distinct().collect()}
    assert dims == {"Region", "Total"}

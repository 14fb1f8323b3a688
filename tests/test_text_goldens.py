"""Text analysis goldens (FIXTURES.md F3)."""

import pytest
from pyspark.sql import functions as F

from murmur.operators import text
from murmur.operators.text import (analyze_complaints, clean_text, determine_priority, load_text_dedup,
                                   priority_distribution, sentiment_by_category)

GOLDEN = [
    ("This product is terrible and broke after one day. Very disappointed!", -0.5, "Technical Issues", "medium",
     ["product", "terrible", "broke", "after", "very"]),
    ("Excellent service! The team was very helpful and resolved my issue quickly.", 0.5, "Other", "low",
     ["excellent", "service", "team", "very", "helpful"]),
    ("I received the product. It works as described in the manual.", 0.0, "Other", "low",
     ["received", "product", "works", "described", "manual"]),
    ("The product quality is very poor and it's defective.", -0.5, "Product Quality", "medium",
     ["product", "quality", "very", "poor", "defective"]),
    ("This is urgent! The product is dangerous and needs immediate attention!", 0.0, "Other", "high",
     ["urgent", "product", "dangerous", "needs", "immediate"]),
    ("The product quality is poor and customer service was unhelpful", -0.5, "Customer Service", "medium",
     ["product", "quality", "poor", "customer", "service"]),
    ("This product is broken and terrible. I need a refund immediately!", -0.5, "Product Quality", "high",
     ["product", "broken", "terrible", "need", "refund"]),
    ("The product is broken", 0.0, "Product Quality", "low", ["product", "broken"]),
    ("Great customer service!", 0.5, "Customer Service", "low", ["great", "customer", "service"]),
    ("", 0.0, "Other", "low", []),
]


@pytest.fixture(scope="module")
def analyzed(spark):
    rows = [(i, t) for i, (t, *_rest) in enumerate(GOLDEN)] + [(99, None)]
    df = spark.createDataFrame(rows, "complaint_id long, complaint_text string")
    return {r["complaint_id"]: r for r in analyze_complaints(df).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(analyzed, i):
    text, score, category, priority, keywords = GOLDEN[i]
    r = analyzed[i]
    assert r["sentiment_score"] == score
    assert r["sentiment"] == {0.5: "positive", -0.5: "negative", 0.0: "neutral"}[score]
    assert r["category"] == category
    assert r["priority"] == priority
    assert r["keywords"] == keywords


def test_null_text_is_the_failure_row(analyzed):
    r = analyzed[99]
    assert (r["sentiment"], r["sentiment_score"], r["category"], r["priority"], r["keywords"], r["cleaned_text"]) == \
        ("unknown", 0.0, "Other", "low", [], "")


def test_urgent_with_very_negative_score_is_critical(spark):
    df = spark.createDataFrame([("This is urgent!",)], "t string")
    assert df.select(determine_priority(F.col("t"), F.lit(-0.8))).first()[0] == "critical"


def test_cleaning(spark):
    df = spark.createDataFrame([("This is a TEST complaint!!!",),
                                ("See HTTPS://x.io/a?b=1 or www.y.com, mail a.b@c.de now; it's  bad",),
                                ("@lead and trail@ stay, x@y goes",)], "t string")
    got = [r[0] for r in df.select(clean_text(F.col("t"))).collect()]
    assert got == ["this is a test complaint!!!", "see or mail now its bad", "lead and trail stay, goes"]


def test_distributions_and_dedup(spark):
    df = spark.createDataFrame([(1, "bad app"), (2, "bad app"), (3, None), (4, "great")],
                               "complaint_id long, text string")
    d = load_text_dedup(df)
    assert sorted(r["complaint_id"] for r in d.collect()) == [1, 4]
    a = analyze_complaints(d)
    pri = {r["priority"]: r["count"] for r in priority_distribution(a).collect()}
    assert pri == {"low": 1, "medium": 1, "high": 0, "critical": 0}
    x = {r["category"]: (r["negative"], r["positive"]) for r in sentiment_by_category(a).collect()}
    assert x == {"Technical Issues": (1, 0), "Other": (0, 1)}


def test_row_local_keywords_equal_set_based(spark):
    from murmur.operators.text import extract_keywords
    from murmur.sources.tables import read_table
    d = read_table(spark, "/root/testdata/sf0.001", "documents")
    a = extract_keywords(d, "doc_id", "text").collect()
    b = extract_keywords(d, "doc_id", "text", row_local=True).collect()
    assert sorted(a) == sorted(b)
    g = [(i, t) for i, (t, *_r) in enumerate(GOLDEN)]
    df = spark.createDataFrame(g, "complaint_id long, complaint_text string")
    x = {r["complaint_id"]: r["keywords"] for r in analyze_complaints(df, row_local_keywords=True).collect()}
    assert [x[i] for i in range(len(GOLDEN))] == [row[4] for row in GOLDEN]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keywords_of_unique_ids_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "late late parcel, Parcel late"), (2, None), (3, "")], "id long, text string")
    top = text.extract_keywords(df, "id", "text")
    assert [tuple(r) for r in top.orderBy("rank").collect()] == [(1, "late", 3, 0, 1), (1, "parcel", 2, 2, 2)]
    assert "Exchange" not in _plan(top) and "Window" not in _plan(top)


def test_keywords_of_repeated_and_missing_ids_are_counted_together(spark):
    rows = [(1, "alpha beta"), (1, "beta gamma beta"), (None, "delta"), (None, "delta alpha"), (2, "alpha alpha zeta")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r["id"], r["word"]): (r["freq"], r["first_pos"]) for r in text.extract_keywords(df, "id", "text").collect()}
    assert got == {(1, "beta"): (3, 0), (1, "alpha"): (1, 0), (1, "gamma"): (1, 1), (None, "delta"): (2, 0), (None, "alpha"): (1, 1),
                   (2, "alpha"): (2, 0), (2, "zeta"): (1, 2)}


def test_analysis_counts_keywords_in_arrow_batches(spark):
    df = spark.createDataFrame([(1, "slow slow refund Refund the x"), (2, None)], "complaint_id long, complaint_text string")
    out = text.analyze_complaints(df)
    assert {r["complaint_id"]: r["keywords"] for r in out.collect()} == {1: ["slow", "refund"], 2: []}
    assert "ArrowEvalPython" in _plan(out) and "array_sort" not in _plan(out)


def test_lemmas_shuffle_words_of_chunks_not_tokens(spark, monkeypatch):
    monkeypatch.setattr(text, "LEMMA_CHUNK_BYTES", 40)
    rows = [(1, "cats  and dogs cats"), (1, "dogs ran"), (None, None), (2, "no  change"), (3, "cats " * 50), (3, "cats " * 50)]
    df = spark.createDataFrame(rows, "id long, text string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("cats", "cax"), ("dogs", "dog"), ("no", "no")], "form string, lemma string")
    out = text.lemmatize(df, "text", "id", lemmas)
    cats = " ".join(["cat"] * 50)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "cat and dog cat"), (1, "dog ran"), (None, None), (2, "no  change"), (3, cats), (3, cats)], key=str)
    assert "posexplode" not in _plan(out) and "collect_set" not in _plan(out)

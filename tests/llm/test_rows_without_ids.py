"""Pipeline stages on rows that share an id or have none: decisions go by row, not by id."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from murmur.llm import decontaminate, simhash

COLUMNS = "doc_id long, text string, source string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return [words(rng, 60) for _ in range(6)]


def test_near_dedup_keeps_one_row_of_each_group(spark, texts):
    a, b, c, d, e, _ = texts
    rows = [(1, a, "s"), (1, b, "s"), (2, a, "s"), (1, a, "s"),      # an id with two texts, one of them twice
            *[(None, c, "s")] * 40, (None, d, "s"),                  # copies without id
            (7, e, "s"), (None, e, "s"), (8, e.upper(), "s"),
            (9, None, "s"), (None, "", "s")]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    out = simhash.keep_one_per_group(docs)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(
        [(1, a, "s"), (1, b, "s"), (None, c, "s"), (None, d, "s"), (7, e, "s"), (9, None, "s")])


def test_decontamination_drops_only_rows_that_match(spark, texts):
    a, b, c, d, e, item = texts
    rows = [(1, a, "s"), (1, f"{b} {item}", "s"), (None, c, "s"), (None, f"{item} {d}", "s"), (None, None, "s"), (2, e, "s"), (2, e, "s")]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    out = decontaminate.drop_contaminated(docs, items)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(r for r in rows if item not in (r[1] or ""))

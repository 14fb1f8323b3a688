"""Filter audit against a plain loop over documents and orders."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from murmur.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, mask int, steps string, id long, key string, n long"
LABELS = "doc_id long, quality int, toxic int, part string, n long"


def rows():
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", " \t\n", "short text", long, long, long.upper(), long + " #", "a b " * 60, "A$ " * 150, "É" * 30 + " Z",
             " ".join(["x"] * 30 + [f"y{i}" for i in range(90)]), "w x " * 100, long * 200, "$", "", long, "Ab" * 5_000]
    out = [(i, t, ["en", "fr", None, "", "de"][i % 5], "p", 1, "s", 7, "k", 9) for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, long, "en", "p", 1, "s", 7, "k", 9), (None, "$ alone", None, "p", 1, "s", 7, "k", 9)]
    return out


def labels():
    return [(i, i % 2, i % 3 == 0, "z", 5) for i in range(0, 18, 2)] + [(4, 1, 0, "z", 5), (None, 1, 1, "z", 5), (99, 1, 1, "z", 5), (6, None, None, "z", 5)]


def brute(docs, marks):
    good, toxic = ({d for d, *x in marks if d is not None and x[k] == 1} for k in (0, 1))
    held = []
    for d, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": re.search("[#$%&*|]", t) is not None,
                 "E": d is not None and any(o[0] is not None and o[0] < d and (o[1] or "") == t for o in docs)}
        held.append((lang or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    want, shapley = {}, Counter()
    for part in {p for p, *_ in held}:
        mine = [x[1:] for x in held if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                want[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[0] for x in mine) - len(gone),
                                                     sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_audit_matches_brute_force(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    marks = spark.createDataFrame([(a, b, None if c is None else int(c), d, e) for a, b, c, d, e in labels()], LABELS)
    out = filter_audit.audit(docs, marks)
    assert out.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    got = {tuple(r[:3]): tuple(r[3:]) for r in out.collect()}
    assert got == brute(rows(), labels()) and len(got) == 4 * 600


def test_audit_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], LABELS)
    out = filter_audit.audit(docs, none)
    assert {(r["good_lost"], r["toxic_lost"]) for r in out.collect()} == {(0, 0)}
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), none).count() == 0

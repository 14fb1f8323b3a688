"""Whitening against numpy and exact integers; the polynomial and its roots against known ones."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from murmur.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, n long, component int, id string, vec string, at int, w double"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1, 2, "x", "y", 3, 4.0) for i, v in zip(ids, vectors)], SCHEMA).repartition(3)


def check(spark, vectors, keep):
    """All columns against exact integers and numpy on the vectors at ``keep``."""
    rows = wh.whiten(frame(spark, vectors)).collect()
    x = [[math.floor(1024 * v) + 100_000 for v in vectors[i]] for i in keep]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    by = defaultdict(dict)
    for r in rows:
        by[r["id"]][r["component"]] = r
        assert r["n"] == n
    assert sorted(by) == sorted(keep) and all(sorted(c) == list(range(1, min(8, d) + 1)) for c in by.values())
    for i, r in zip(keep, x):
        assert {c["deviation"] for c in by[i].values()} == {sum((n * a - b) ** 2 for a, b in zip(r, s))}
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1][:8]
    first = by[keep[0]]
    tol = 1e-9 * max(1.0, values[0])
    assert all(abs(first[k + 1]["eigenvalue"] - v) <= tol for k, v in enumerate(values))
    held = [k for k in range(len(values)) if first[k + 1]["eigenvalue"] > 0]
    assert all(first[k + 1]["whitened"] is None for k in range(len(values)) if k not in held)
    w = np.array([[by[i][k + 1]["whitened"] for k in held] for i in keep])
    if held:
        assert np.abs(w.T @ w / n - np.eye(len(held))).max() <= 1e-4 and first[1]["identity_error"] <= 1e-4
        axes = np.linalg.lstsq(centred, w, rcond=None)[0].T                # up to the null space
        for k, a in zip(held, axes):
            e = first[k + 1]["eigenvalue"]
            a = a * math.sqrt(e)
            assert np.abs(cov @ a - e * a).max() <= 1e-8 * values[0]
            assert abs(first[k + 1]["explained"] - e / np.trace(cov)) <= 1e-9
    return first


def test_random_vectors_with_rows_to_leave_out(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(0, 0.2, (90, 12)).round(3).tolist()
    bad = [None, [], [None] * 12, [0.1] * 11 + [None], [float("nan")] * 12, [0.0] * 11 + [float("inf")], [1.0] * 11, [2.0] * 13]
    check(spark, good + bad + good[:3], [*range(90), 98, 99, 100])


def test_shared_eigenvalues(spark):
    plus = np.eye(10).tolist()
    check(spark, plus + (-np.eye(10)).tolist() + plus, list(range(30)))
    one = [[1.0, 0, 0], [-1.0, 0, 0], [0, 1.0, 0], [0, -1.0, 0], [0, 0, 0.5], [0, 0, -0.5]]
    first = check(spark, one, list(range(6)))
    assert first[1]["eigenvalue"] == pytest.approx(first[2]["eigenvalue"], rel=1e-12)


def test_few_dimensions_and_no_variance(spark):
    line = [[float(i), 2.0 * i, 5.0] for i in range(7)]
    first = check(spark, line, list(range(7)))
    assert first[2]["eigenvalue"] == first[3]["eigenvalue"] == 0
    first = check(spark, [[0.5, 0.25]] * 4, list(range(4)))
    assert first[1]["explained"] is None and first[1]["identity_error"] is None
    check(spark, [[3.0]], [0])
    check(spark, [[1.0], [2.0], [4.5]], [0, 1, 2])


def test_large_entries(spark):
    rng = np.random.default_rng(2)
    big = (rng.normal(0, 1, (40, 4)) * [1e9, 1e3, 1, 1e-2]).tolist()
    rows = wh.whiten(frame(spark, big)).collect()
    x = np.array([[math.floor(1024 * v) for v in r] for r in big], object)
    s = x.sum(axis=0)
    assert all(int(r["deviation"]) == sum((40 * a - b) ** 2 for a, b in zip(x[r["id"]], s)) for r in rows)
    assert rows[0]["identity_error"] < 1e-4
    assert wh.whiten(frame(spark, [[1e300, 1.0], [0.0, 2.0], [1.0, -1e300]])).count() == 6


def test_ids_and_empty_tables(spark):
    out = wh.whiten(frame(spark, [[0.0, 1.0], [1.0, 0.0], [1.0, 0.5], [1.0, 0.5]], [None, 5, 5, 5])).collect()
    assert sorted((r["id"] or -1, r["component"]) for r in out) == sorted([(-1, 1), (-1, 2)] + [(5, 1), (5, 2)] * 3)
    for rows in ([], [None, []]):
        none = wh.whiten(frame(spark, rows))
        assert none.count() == 0 and none.columns == wh.whiten(frame(spark, [[1.0]])).columns


def test_sums_are_exact():
    rng = np.random.default_rng(3)
    for size in (1 << 10, 1 << 19, 1 << 21, 1 << 45, 1 << 62):
        x = rng.integers(-size, size, (300, 5))
        o = x.astype(object)
        assert (wh.exact_gram(x) == o.T @ o).all()


def known(values):
    """e_k of the given roots."""
    sums = [1]
    for v in values:
        sums = [a + v * b for a, b in zip(sums + [0], [0] + sums)]
    return sums


def test_polynomial_of_a_matrix(spark):
    rng = np.random.default_rng(4)
    for d in (1, 2, 7):
        a = rng.integers(-(1 << 40), 1 << 40, (d, max(1, d - 1))).astype(object)
        m = a @ a.T
        sums = wh.minor_sums(spark, m)
        power, c = np.eye(d, dtype=object), 1                                # Faddeev-LeVerrier, exact
        for k in range(1, d + 1):
            power = m @ power if k == 1 else m @ (power + c * np.eye(d, dtype=object).astype(int).astype(object))
            c = Fraction(-int(np.trace(power)), k)
            assert c.denominator == 1 and sums[k] == (-1) ** k * c.numerator
            c = int(c)


def test_roots_with_multiplicity():
    for values in ([9, 9, 9, 4, 4, 1, 0, 0], [10 ** 30, 10 ** 30 - 1, 3, 3, 1], [5], [0, 0]):
        sums = known(values)
        for at in (0, 1, 3, 4, 9, 10 ** 30):
            assert wh.roots_above(sums, at, 0) == sum(v > at for v in values)
        for j, v in enumerate(sorted(values, reverse=True), 1):
            lo, hi, scale = wh.isolate_root(sums, j)
            assert (lo, hi) == (0, 0) if v == 0 else lo < v << scale <= hi and hi - lo << wh.ROOT_BITS <= lo


def test_primes():
    primes = wh.primes_above(1 << 200)
    assert math.prod(primes) > 1 << 200 and len(set(primes)) == len(primes)
    assert all(p % q for p in primes[:3] for q in range(2, 46_342))
    assert [n for n in range(11, 60, 2) if wh.is_prime(n)] == [11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]

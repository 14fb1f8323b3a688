"""The n-gram Jaccard join against all pairs on untidy tables and families of edited copies."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from murmur.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, id long, pid string, region int, n double, root string, kind int, mark string"


def words(rng, n, stem="w"):
    return [f"{stem}{rng.randrange(10 ** 6)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        at, what = rng.randrange(len(out)), rng.randrange(3)
        out[at:at + (what != 0)] = [] if what == 1 else [f"x{rng.randrange(10 ** 6)}"]
    return out


def family(rng, size, n, most):
    base = words(rng, n)
    return [edited(rng, base, rng.randrange(1, most)) for _ in range(size)]


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([b" ".join(w)] if w else [])


def brute(rows, percent=80):
    """(doc_id, n_shingles, component_id) of all pairs; the number of links between different sets."""
    docs = [(d, shingles(t)) for d, t in rows]
    points = list({s for _, s in docs if s})
    low = {s: min((d for d, x in docs if x == s and d is not None), default=None) for s in points}
    near = defaultdict(list)
    for i, a in enumerate(points):
        for b in points[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                near[a].append(b)
                near[b].append(a)
    component = {}
    for s in points:
        if s not in component:
            seen, todo = {s}, [s]
            while todo:
                new = [x for x in near[todo.pop()] if x not in seen]
                seen.update(new)
                todo += new
            lowest = min((low[x] for x in seen if low[x] is not None), default=None)
            component.update(dict.fromkeys(seen, lowest))
    return sorted(((d, len(s), component[s] if s else d) for d, s in docs), key=str), sum(map(len, near.values())) // 2


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(d, t, 1, "p", 2, 3.0, "r", 4, "m") for d, t in rows], SCHEMA).repartition(parts)


def joined(spark, rows, percent=80):
    return sorted(map(tuple, jj.jaccard_components(frame(spark, rows), min_percent=percent).collect()), key=str)


def untidy():
    rng = random.Random(6)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two three four", "one two three four five", "One  two three\nfour FIVE",
             "Ärger ÉTÉ straße " * 9, "ä Ä é " * 30, "a b c d e " * 40, " ".join(words(rng, 20_000)), "!!! ???"]
    for size, n, most in ((3, 60, 3), (6, 200, 10), (25, 80, 4), (40, 146, 6), (5, 12, 2)):
        texts += [" ".join(x) for x in family(rng, size, n, most)]
    passage = words(rng, 60)
    texts += [" ".join(words(rng, rng.randrange(5, 60)) + passage + words(rng, 5)) for _ in range(40)]
    chain = words(rng, 100)
    for i in range(12):                                                  # each links to the next only
        texts.append(" ".join(chain[i * 6:] + [f"c{j}" for j in range(i * 6)]))
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1_000 + i, texts[i]) for i in range(0, 60, 7)]
    return rows + [(5_000, texts[3])] * 30 + [(3, texts[40]), (3, texts[1]), (None, "nobody knows whose text this is at all"), (None, texts[2])]


def test_untidy_table(spark):
    want, n = brute(untidy())
    assert joined(spark, untidy()) == want and n > 60


@pytest.mark.parametrize("percent", [60, 95])
def test_other_similarities(spark, percent):
    rows = untidy()
    assert joined(spark, rows, percent) == brute(rows, percent)[0]


def test_rounds_and_blocks(spark, monkeypatch):
    """A large family whose members are too far for one star, with few pivots a round and small blocks."""
    rng = random.Random(7)
    rows = list(enumerate(" ".join(x) for x in family(rng, 90, 120, 6)))
    monkeypatch.setattr(jj, "PIVOTS", (1, 2, 4))
    monkeypatch.setattr(jj, "SHINGLES_PER_BLOCK", 900)
    want, n = brute(rows)
    assert joined(spark, rows) == want and 100 < n < 90 * 89 / 2 and len({c for _, _, c in want}) > 2


def test_empty_tables(spark):
    out = jj.jaccard_components(frame(spark, []))
    assert out.count() == 0 and out.columns == ["id", "n_shingles", "component_id"]
    assert joined(spark, [(4, None), (5, "")]) == [(4, 0, 4), (5, 0, 5)]
    with pytest.raises(ValueError):
        jj.jaccard_components(frame(spark, []), min_percent=50)


def test_rarest_shingles_meet():
    """Two linked sets always have one of their rarest pool shingles in common, whatever the order."""
    rng = np.random.default_rng(8)
    for _ in range(3_000):
        percent = int(rng.choice([51, 60, 80, 90]))
        both = int(rng.integers(1, 60))
        a, b = sorted(rng.integers(0, both + 1, 2).tolist())
        x, y = np.arange(both + a), np.concatenate([np.arange(both), np.arange(100, 100 + b)])
        if 100 * both < percent * (both + a + b):
            continue
        by_hash, by_number = rng.permutation(200), rng.permutation(200)
        cells = []
        for s in (x, y):
            n = np.array(len(s))
            pool = s[np.argsort(by_hash[s])][:jj.pool_size(n, percent)]
            cells.append(set(pool[np.argsort(by_number[pool])][:jj.missing(n, percent) + 2].tolist()))
        assert cells[0] & cells[1]

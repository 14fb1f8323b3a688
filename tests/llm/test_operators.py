"""The corpus operators against brute force on a small, untidy table: nulls,
empty and long texts, ties, repeated rows, clashing extra columns, no rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from murmur.llm import chat, decontaminate, langid, line_dedup, lm, mixing, passages, simhash, topk, warc
from murmur.llm.components import connected_components, spanning_forest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, doc long, h1 long, pos int, size string, word string")


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randrange(500)}" for _ in range(n))


def make_rows():
    rng = random.Random(5)
    line, passage = "Shared LINE of the corpus, " + words(rng, 8), words(rng, 60, "p")
    rows = [(i, words(rng, 30 + i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, f"{words(rng, 10)}\n {line.upper() if i % 2 else line}\t\n{words(rng, 12)}\n\n", "en", "s0") for i in range(6)]
    rows += [(200 + i, f"{words(rng, 30)} {passage} {words(rng, 20)}", "fr", None) for i in range(4)]
    rows += [(300, rows[3][1], "en", "s1"), (301, rows[3][1] + " extra", "en", "s1"), (302, rows[3][1], None, "s1")]
    rows += [(400, None, None, None), (401, "", "de", "s2"), (402, " \t\n", "de", "s2"), (None, "no id here", "de", "s2"),
             (403, "4 5 6 !!", "en", "s2"), (404, "Ärger ÉTÉ straße " * 9, "de", "s2")]
    rows += [(405, words(rng, 20_000, "long"), "en", "s1")]
    rows += [(3, rows[3][1], "en", "s0")] * 2                       # repeated rows
    return rows


ROWS = make_rows()
PASSAGE_DOCS = {200, 201, 202, 203}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 7, 8, 9, "x", "y") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return (t or "").encode().lower().split()


def test_line_dedup(docs, none):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t, *_ in ROWS:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(-1 if d is None else d)
    want = Counter()
    for d, t, *_ in ROWS:
        lines = (t or "").split("\n")
        gone = [len(held[key(x)]) >= 5 and max(held[key(x)]) != d for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        want[d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, line_dedup.line_report(docs).collect())) == want
    assert sum(n * k for (_, _, n, _), k in want.items()) == 5
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert line_dedup.line_report(none).count() == 0


def test_mixing(docs, none):
    out = mixing.mix(docs).collect()
    size = {s: sum(len(tokens(t)) for _, t, _, x in ROWS if x == s) for s in ("s0", "s1", "s2", None)}
    weights = dict(zip(["s0", "s1", "s2", None], [3, 1, 2, 3]))
    target, left, free = {}, 1.5 * sum(size.values()), set(size)
    while free:                                                      # reshare until none is above its cap
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    assert len(out) == len(ROWS)
    for s in size:
        mine = [r for r in out if r["source"] == s]
        assert all(r["source_size"] == size[s] and math.isclose(r["target"], target[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 0.5
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(r["mix_words"] for r in mixed) == sum(r["taken"] for r in out)
    assert all(len(tokens(r["text"])) == r["mix_words"] for r in mixed)
    assert mixing.mix(none).count() == 0


def brute_fingerprint(t):
    w = tokens(t)
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, none):
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in ROWS]
    low = {}
    for _, f in fps:                                                 # smallest id over links, to a fixed point
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            near = {g for _, g in fps if (x ^ g).bit_count() <= 3} - seen
            seen |= near
            todo += near
        low[f] = min((d for d, g in fps if g in seen and d is not None), default=None)
    got = Counter((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((d, f, low[f]) for d, f in fps)
    kept = Counter(r["doc_id"] for r in simhash.keep_one_per_group(docs).collect())
    assert kept == Counter({d: 1 for d in low.values()})
    assert simhash.near_duplicates(none).count() == 0


def test_vantage_point_search_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    p = np.unique(np.concatenate([p, p[:400] ^ np.uint64(5), p[:200] ^ np.uint64(1 << 40)]))
    want = {(int(a), int(b)) for i, a in enumerate(p) for b in p[i + 1:][np.bitwise_count(p[i + 1:] ^ a) <= 3]}
    monkeypatch.setattr(simhash, "LEAF_POINTS", 32)
    got = set()
    for _, own, visit in simhash.route(simhash.build_tree(p[::4], 6), p, 3):
        for x, y in simhash.near_pairs(p[own], p[visit], 3):
            got |= {(min(int(a), int(b)), max(int(a), int(b))) for a, b in zip(x, y)}
    assert got == want


def test_components(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    edges = [*zip(a.tolist(), b.tolist()), *chain, (5, 5), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for x, y in edges:
        if x is not None and x != y:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    n, r = spanning_forest(a[a != b], b[a != b])
    assert {x: int(y) for x, y in zip(n.tolist(), r)} == {x: y for x, y in got.items() if x < 1000 and x != y}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(docs, none, spark):
    model = langid.fit(docs)
    got = [(r["text"], r["lang_pred"], r["lang_score"]) for r in langid.identify(docs, model).collect()]
    assert len(got) == len(ROWS)
    for t, lang, score in got:
        assert (lang == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= score <= 1
        assert lang in ("und", "en", "fr", "de")
    fit = spark.createDataFrame([("the cat and the hat", "en"), ("le chat et la table", "fr"), (None, "fr"), ("x", None)],
                                "text string, lang string")
    asked = spark.createDataFrame([("the the",), ("chats",), ("hatted",)], "text string")
    assert [r["lang_pred"] for r in langid.identify(asked, langid.fit(fit)).collect()] == ["en", "fr", "en"]
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def plain_language(labelled, text, max_gram=4):
    """The language and score of ``text``, straight from the definition."""
    def parts(w, n):
        m = f" {w} "
        return [w] if n == 0 else list(w) if n == 1 else [m[i:i + n] for i in range(len(m) - n + 1)]

    seen = {(lang, n): Counter(g for t, k in set(labelled) if t is not None and k == lang for w in langid.words_of(t) for g in parts(w, n))
            for lang in {k for t, k in labelled if k and t is not None} for n in range(max_gram + 1)}
    langs = sorted({k for k, n in seen if any(seen[k, m] for m in range(max_gram + 1))})
    vocabulary = {n: set().union(*(seen[k, n] for k in langs)) for n in range(max_gram + 1)}
    asked = langid.words_of(text or "")
    if not asked or not langs:
        return "und", 0.0
    total, blank = dict.fromkeys(langs, 0.0), 0
    for w in asked:
        for n in (0, *range(max_gram, 0, -1)):
            if known := [g for g in parts(w, n) if g in vocabulary[n]]:
                for k in langs:
                    size = sum(seen[k, n].values()) + 0.5 * max(1, len(vocabulary[n]))
                    total[k] += sum(math.log10((seen[k, n][g] + 0.5) / size) for g in known) / len(known)
                break
        else:
            blank += 1
    weight = min(len(asked), langid.EVIDENCE_WORDS) / len(asked)
    odds = {k: 10 ** ((total[k] - max(total.values())) * weight) for k in langs}
    best = max(langs, key=lambda k: (odds[k], [-ord(c) for c in k]))
    return best, odds[best] / sum(odds.values()) * (1 - blank / len(asked))


def test_language_id_against_the_plain_definition(spark):
    rng = random.Random(3)
    stems = {"en": "the cat hat and house", "fr": "le chat la table et maison", "de": "die katze das haus und straße"}
    labelled = [(" ".join(rng.choices(stems[k].split(), k=rng.randint(3, 12))), k) for k in stems for _ in range(15)]
    labelled += [labelled[0]] * 5 + [(None, "en"), ("nothing learned", None), ("", "de"), ("42", "xx")]
    asked = ["the cat", "chats", "hatted houses", "Straßen und Häuser", "Привет мир", "日本語", "cat Привет мир", "", None, "7 8", "zzz qqq",
             "le chat the " * 60, *(t for t, _ in labelled[:9])]
    model = langid.fit(spark.createDataFrame(labelled, "text string, lang string"))
    got = langid.identify(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model, keep=["i"]).collect()
    assert len(got) == len(asked)
    for i, lang, score in got:
        want = plain_language(labelled, asked[i])
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-9), (asked[i], lang, score, want)
    assert plain_language(labelled, "Привет мир")[1] == 0.0


def test_learning_sample_is_bounded_under_copies(spark):
    rows = spark.range(4000).selectExpr("'one text over and over' AS text", "'en' AS lang").unionAll(
        spark.range(3000).selectExpr("concat('text ', id) AS text", "'en' AS lang")).unionAll(
        spark.range(20).selectExpr("concat('texte ', id) AS text", "'fr' AS lang"))
    sample = langid.learning_sample(rows, rows_per_lang=500)
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 500, "fr": 20}
    assert sample.distinct().count() == 520


def test_lm_scoring(docs, none):
    train = [t for d, t, *_ in ROWS if d is None or d % 2]
    counts = Counter(x for t in train for x in [*tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t, *_ in ROWS:
        tok = [*tokens(t), b""]
        want[d, len(tok), sum(counts[x] > 0 for x in tok), n,
             round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tok), 6)] += 1
    out = lm.score_texts(docs, docs.filter("doc_id is null or doc_id % 2 = 1"), head_words=50).collect()
    assert Counter((r[0], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert lm.score_texts(none, docs).count() == 0
    assert {r["base_score"] for r in lm.score_texts(docs.limit(3), none).collect()} == {0.0}


def test_lm_score_against_a_plain_model(docs):
    """The filter's scores against levels of exact counts: equal but for the filter's seldom false positives."""
    train = [t for d, t, *_ in ROWS if d is None or d % 2]
    uni, bi = Counter(), Counter()
    for t in train:
        seq = [b"", *tokens(t), b""]
        uni.update(seq[1:])
        bi.update(zip(seq, seq[1:]))
    total, distinct = sum(uni.values()), len(uni)

    def middle(c, none):                                                 # middle count of the level floor(2 log2 c)
        if c < 2:
            return none
        level = math.floor(2 * math.log2(c) + 1e-9)
        low, high = (math.ceil(2 ** ((level + k) / 2) - 1e-9) for k in (0, 1))
        return (low + max(high - 1, low)) / 2

    def plain(text):
        seq, out = [b"", *tokens(text), b""], 0.0
        for v, w in zip(seq, seq[1:]):
            c1, cv = middle(uni[w], 0.5), middle(uni[v], 0.5)
            p1 = (c1 + 1) / (total + distinct + 1)
            out += math.log10((min(middle(bi[v, w], 0.0), cv) + lm.PRIOR * p1) / (cv + lm.PRIOR))
        return out

    training = docs.filter("doc_id is null or doc_id % 2 = 1")
    rows = lm.score_texts(docs, training, keep=["doc_id", "text"]).collect()
    off = [abs(r["score"] - plain(r["text"])) / r["n_tokens"] for r in rows]
    assert sum(x < 1e-9 for x in off) > 0.5 * len(off) and max(off) < 0.1


@pytest.mark.parametrize("size", [1 << 25, 0])
def test_lm_learns_words_and_pairs_seen_once(spark, size):
    """With ``min_count`` 1 a pair seen once counts once."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words)) + " new")], "doc_id long, text string")
    rows = lm.score_texts(docs, docs.filter("doc_id = 1"), max_filter_bytes=size, min_count=1).collect()
    norm = 401 + 401 + 1
    known, unknown = ((c + lm.PRIOR * 2 / norm) / (1 + lm.PRIOR) for c in (1, 0))
    got = {r["doc_id"]: r["score"] for r in rows}
    assert got[1] == pytest.approx(401 * math.log10(known), abs=2)    # seldom false positives of the filter
    assert got[2] == pytest.approx(402 * math.log10(unknown), abs=25)


def test_lm_scores_do_not_depend_on_the_filter_s_form(docs, none):
    training = docs.filter("doc_id is null or doc_id % 2 = 1")
    whole, large = (sorted(map(tuple, lm.score_texts(docs, training, max_filter_bytes=size).collect()), key=str) for size in (1 << 25, 0))
    assert whole == large and len(whole) == len(ROWS)
    assert lm.score_texts(none, docs, max_filter_bytes=0).count() == 0


@pytest.mark.parametrize("head_codes", [0, 300])
def test_lm_large_filter_scores_alike_in_many_buckets(docs, monkeypatch, head_codes):
    """Counts of many buckets, texts in many chunks and a few frequent codes known everywhere: the same scores."""
    monkeypatch.setattr(lm, "CODES_PER_BUCKET", 3_000)
    monkeypatch.setattr(lm, "CHUNK_CHARS", 20_000)
    training = docs.filter("doc_id is null or doc_id % 2 = 1")
    whole, large = (Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
                            for r in lm.score_texts(docs, training, max_filter_bytes=size, min_count=1, head_codes=head_codes).collect())
                    for size in (1 << 25, 0))
    assert whole == large and whole.total() == len(ROWS)


@pytest.mark.parametrize("condition", ["doc_id is null or doc_id % 2 = 1", "doc_id % 2 = 1"])
def test_lm_learns_from_a_condition_on_the_scored_rows(docs, monkeypatch, condition):
    """A chunk sends its codes once, to be counted and answered: the same scores, null conditions left out, no table of the filter."""
    monkeypatch.setattr(lm, "CODES_PER_BUCKET", 3_000)
    monkeypatch.setattr(lm, "CHUNK_CHARS", 20_000)
    tables, real = [], lm.staged
    monkeypatch.setattr(lm, "staged", lambda df, name: tables.append(name) or real(df, name))
    apart, whole, large = (Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
                                   for r in lm.score_texts(docs, train, max_filter_bytes=size, min_count=1).collect())
                           for train, size in ((docs.filter(condition), 1 << 25), (F.expr(condition), 1 << 25), (F.expr(condition), 0)))
    assert apart == whole == large and whole.total() == len(ROWS)
    assert tables == ["lm-words", "lm-filter", "lm-scored"] * 2 + ["lm-words", "lm-scored"]


def test_lm_bound_on_the_filter_s_keys():
    """No count has more levels than the bound that decides the filter's form allows."""
    c = np.arange(1, 1 << 16)
    assert (np.floor(2 * np.log2(c) + 1e-9) + 1 <= lm.KEYS_PER_COUNT * c).all()


def test_sorted_codes_travel_as_planes():
    codes = np.unique(np.random.default_rng(3).integers(0, 2**64, 5_000, dtype=np.uint64))
    assert (lm.from_planes(lm.planes(codes)) == codes).all() and len(lm.from_planes(lm.planes(codes[:0]))) == 0
    assert len(zlib.compress(lm.planes(codes), 1)) < 0.9 * codes.nbytes


def test_log_frequency_filter(spark):
    rng = np.random.default_rng(2)
    codes, n = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64)), rng.integers(2, 5000, 20_000)
    table = spark.createDataFrame([(int(c), int(k)) for c, k in zip(codes, n)], "code long, n long")
    bloom = lm.build_filter(table)
    got = bloom.levels(codes)
    want = np.floor(2 * np.log2(n[:len(codes)]) + 1e-9)
    assert (got >= want).all() and (got == want).mean() > 0.97       # never too low, seldom too high
    assert (bloom.levels(rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)) > 0).mean() < 0.03
    assert len(bloom.bits) * 8 >= 10 * int((want - 1).sum()) and bloom.min_level == lm.MIN_LEVEL


def test_decontamination(docs, none, spark):
    passage = ROWS[30 + 6][1].split()[30:90]
    edited = [w if i % 7 else "changed" for i, w in enumerate(passage)]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(edited)), (3, "nowhere to be found at all"), (4, None),
                                   (5, "two words"), (1, " ".join(passage))], "item_id long, text string")
    got = {(r["doc"], r["item"]): (r["similarity"], r["first_word"], r["n_words"])
           for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(d, i) for d in PASSAGE_DOCS for i in (1, 2)}
    assert all(got[d, 1] == (1.0, 30, 60) for d in PASSAGE_DOCS)
    kept = [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()]
    assert Counter(kept) == Counter(d for d, *_ in ROWS if d not in PASSAGE_DOCS)
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs, items, block_words=60).count() == 3 * len(PASSAGE_DOCS)     # item 1 twice


def test_alignment_by_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        a, b = [rng.randrange(5) for _ in range(9)], [rng.randrange(5) for _ in range(14)]
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0.0, h[i][j] + (1 if x == y else -0.5), h[i][j + 1] - 0.5, h[i + 1][j] - 0.5)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_substring_dedup(docs, none):
    got = passages.near_duplicate_passages(docs).collect()
    pairs = {(r["other"], r["doc"]) for r in got}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        root[find(b)] = find(a)
    assert len({find(d) for d in PASSAGE_DOCS}) == 1
    # rows 3, 300, 301 and 302 have 33 words: too short to be a passage
    assert {d for p in pairs for d in p} == PASSAGE_DOCS
    assert all(r["n_words"] >= 50 and r["similarity"] >= 0.8 for r in got)
    assert passages.near_duplicate_passages(none).count() == 0


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(6)
    sh = rng.integers(1, 2**63, 120, dtype=np.uint64)
    owner = np.zeros(120, np.int64)
    owner[70] = -1
    width = 12
    h = np.where(owner < 0, np.uint64(0), passages.mix64(sh, 11) | np.uint64(1))
    want = set()
    for c in np.flatnonzero(owner >= 0):
        lo = hi = c
        while lo > 0 and h[lo - 1] > h[c]:
            lo -= 1
        while hi + 1 < 120 and h[hi + 1] >= h[c]:
            hi += 1
        if hi - lo + 1 >= width:
            want.add((c, c - lo, hi - c))
    w = passages.compact_windows(sh, owner, np.arange(120, dtype=np.int32), width)[0]
    assert {(int(r["at"]), int(r["left"]), int(r["right"])) for r in w} == want


def test_warc(spark):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "http://a", "<p>é</p>"),
            (5, "http://c", "x" * 200_000), (4, "http://a", "<p>é</p>"), (6, "http://d", "HTTP/1.1 200\r\n\r\nbody\r\n\r\n"),
            (None, "http://e", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter((r["source_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.pages_to_warc(pages).collect())
    best, want, answered = {}, Counter(), set()
    for p, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if p is None else p)
    for p, _, t in rows:
        body = (t or "").encode()
        first = p == best[t or ""] and (p, body) not in answered
        answered.add((p, body))
        want[p, len(body), warc.sha1_base32(body), "response" if first else "revisit", None if first else best[t or ""]] += 1
    assert got == want
    assert warc.pages_to_warc(pages.limit(0)).count() == 0
    big = b"y" * (warc.EMPTY_MEMBER_FROM + 5)
    assert list(warc.members(warc.member(big) + b"\0" + warc.member(b"z") + b"\0")) == [big, b"z"]


def test_exact_top_k(spark):
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(300, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(7, vecs[7].tolist()), (400, None), (420, [1.0, None]), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").filter("vec_id is not null")
    got = defaultdict(list)
    for r in topk.search_vectors(df, F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["neighbor_id"]))
    codes = [(i, [(x or 0) > 0 for x in v] + [False] * (64 - len(v))) for i, v in rows if v is not None and i is not None]
    want = {q: sorted((sum(x != y for x, y in zip(a, b)), i) for i, b in codes if i != q)[:5] for q, a in codes if q % 20 == 0}
    assert got == want
    assert topk.search_vectors(df.limit(0), F.col("id") % 20 == 0).count() == 0
    split = topk.top_k(topk.sign_codes(df), topk.sign_codes(df).filter("id % 20 = 0"), 5, shard_rows=50, query_block=4)
    assert {(r["query_id"], r["rank"]): (r["distance"], r["neighbor_id"]) for r in split.collect()} == {
        (q, k + 1): hit for q, hits in want.items() for k, hit in enumerate(hits)}


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 2, "bob", "two"), (1, 1, "ann", "one <|im_end|>"), (1, 3, None, None), (1, 3, None, None),
            (2, 0, "system", "alone"), (None, 0, "ann", "nobody's")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv"], r["speaker"]): r for r in chat.rotate_perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    r = got[1, "bob"]
    assert r["text"] == ("<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>user name=ann\none < |im_end|><|im_end|>\n"
                         "<|im_start|>assistant\ntwo<|im_end|>\n" + "<|im_start|>user name=unknown\n<|im_end|>\n" * 2)
    assert [r["text"][m["start"]:m["end"]] for m in r["mask"]] == ["two<|im_end|>"]
    assert [(x["n_turns"], x["n_target_turns"]) for x in (got[1, "unknown"], got[None, "ann"])] == [(5, 2), (1, 1)]
    parts = chat.rotate_perspectives(df, part_turns=2).filter("conv = 1 and speaker = 'ann'").orderBy("part").collect()
    assert [p["n_turns"] for p in parts] == [2, 2, 1] and "".join(p["text"] for p in parts) == got[1, "ann"]["text"]
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [40, 128, 130])
def test_exact_top_k_of_any_width(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, width)))] + [(500, [1.0] * (width - 30))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.search_vectors(df, F.col("id") % 20 == 0, k=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["neighbor_id"]))
    bits = {i: [x > 0 for x in v] + [False] * (width - len(v)) for i, v in rows}
    assert got == {q: sorted((sum(x != y for x, y in zip(bits[q], b)), i) for i, b in bits.items() if i != q)[:4]
                   for q in bits if q % 20 == 0}


def test_decontamination_by_brute_force(spark):
    """Every document against every item by plain alignment: copies with words changed or missing, seeds that occur nowhere."""
    rng = random.Random(8)
    texts, items = [], [[f"i{k}w{rng.randrange(60)}" for _ in range(rng.choice([12, 25, 40]))] for k in range(6)]
    for item in items:
        for share in (0.0, 0.1, 0.2, 0.25, 0.3, 0.4):
            copy = [w if rng.random() >= share else rng.choice(["new", "old", None]) for w in item]
            texts.append([f"x{rng.randrange(99)}" for _ in range(20)] + [w for w in copy if w] + [f"x{rng.randrange(99)}" for _ in range(9)])
        texts.append([w if i % 4 else f"q{i}" for i, w in enumerate(item)])
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            number = {w: n for n, w in enumerate(dict.fromkeys(item))}
            score = decontaminate.align(np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in text]))[0]
            if score >= decontaminate.MIN_SIMILARITY * len(item):
                want.add((d, i))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc"], r["item"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 20


def test_line_dedup_sorts_within_the_ranges(docs):
    plan = line_dedup.line_bitmaps(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Window [lag(1" in plan

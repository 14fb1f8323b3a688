"""The pipeline's stages on a small table: decisions take effect, clean documents stay, columns are kept."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    item, line = words(rng, 30), words(rng, 14)
    clean = {i: words(rng, 80) for i in range(12)}
    texts = clean | {20: clean[3], 21: clean[3], 30: words(rng, 20) + " " + item + " " + words(rng, 20), 40: "12 34 !!", 41: None}
    texts |= {50 + i: f"{words(rng, 60)}\n{line}\n{words(rng, 60)}" for i in range(5)}
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_epoch", "mix_words"]
    # what the stages before the mix leave, by plain Python: no text without letters, the shared line in the
    # largest id only, the smallest id of the copies, no document with the benchmark item
    left = {i: t for i, t in clean.items()} | {50 + i: texts[50 + i] if i == 4 else texts[50 + i].replace(f"{line}\n", "") for i in range(5)}
    got = out.collect()
    assert {r["doc_id"] for r in got} <= set(left)
    size, taken = Counter(), Counter()
    for i, t in left.items():
        size[f"s{i % 2}"] += len(t.split())
    for r in got:
        taken[r["source"]] += r["mix_words"]
        whole = left[r["doc_id"]]
        assert r["text"] == (whole if r["mix_words"] == len(whole.split()) else " ".join(whole.split()[:r["mix_words"]]))
    total = sum(size.values())
    wanted = {"s0": 1.5 * total * 3 / 4, "s1": 1.5 * total / 4}
    spare = max(0, wanted["s0"] - 2 * size["s0"])
    assert abs(taken["s0"] - (wanted["s0"] - spare)) <= 1 and abs(taken["s1"] - (wanted["s1"] + spare)) <= 1

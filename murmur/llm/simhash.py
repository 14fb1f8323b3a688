"""SimHash near-dedup with vantage-point trees over 64-bit fingerprints.

A tree of vantage points, fitted on a bounded sample of fingerprints, cuts
the space into shards: a fingerprint belongs to the shard it falls in.  Where
its ball of ``max_bits`` crosses a boundary (triangle bound), it also visits
the shards beyond; of two fingerprints that a boundary parts, the inner one
visits the outer one's side, so each pair is met once.  Each shard searches its own fingerprints
with a vantage-point tree of its own and returns a spanning forest of the
pairs found, so no group is ever expanded into all pairs.  Equal fingerprints
are one point; components of the links are found by distributed joins.

Defined cases: a null or empty text, or one without words, has fingerprint
zero and links like any other; repeated rows share their fingerprint and so
their component; a component of rows without any id has a null component_id;
an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import fold_words, map_arrow, signed, staged, text_chunks
from murmur.llm.components import connected_components, spanning_forest

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
SHARD_POINTS = 32_768       # fingerprints a shard is meant to hold
SAMPLE_PER_SHARD = 32       # fingerprints the tree is fitted on, per shard
SAMPLE_MAX = 131_072        # bound of that sample (1 MB on the driver)
LEAF_POINTS = 512           # points that are compared one by one


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text."""
    words = fold_words(text)
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(words) - shingle_words + 1
    step = 65_536
    for i in range(0, n, step):
        s, e = starts[i:min(i + step, n)].tolist(), ends[i + shingle_words - 1:min(i + step, n) + shingle_words - 1].tolist()
        hashes = np.array([digest(view[x:y], HASH_SEED) for x, y in zip(s, e, strict=True)], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) per row; ``fp`` holds the fingerprint's bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_chunks(batch, "text"):
                fps = [fingerprint(t.as_py(), shingle_words) for t in batch.column("text")[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], signed(np.array(fps, dtype=np.uint64))],
                                                 ["id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                     f"id {id_type}, fp long")


def _bits(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The candidate whose distances spread most, with the median distance; None if nothing splits."""
    best = None
    for v in points[rng.integers(0, len(points), 6)]:
        d = _bits(points, v)
        mid = int(np.median(d))
        if mid == d.max():
            mid -= 1
        if d.min() <= mid < d.max() and (best is None or d.var() > best[0]):
            best = d.var(), v, mid
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int) -> list[tuple]:
    """Nodes (vantage, radius, inner node, outer node) or (shard,), root first."""
    rng, nodes, n_leaves = np.random.default_rng(7), [None], 0
    todo = [(0, sample, max(1, shards))]
    while todo:
        at, points, want = todo.pop()
        split = _vantage(points, rng) if want > 1 and len(points) > 1 else None
        if split is None:
            nodes[at] = (n_leaves,)
            n_leaves += 1
            continue
        v, radius = split
        inner = _bits(points, v) <= radius
        left = max(1, round(want * inner.mean()))
        nodes[at] = (v, radius, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(nodes[at][2], points[inner], left), (nodes[at][3], points[~inner], max(1, want - left))]
    return nodes


def _sides(d_own: np.ndarray, d_visit: np.ndarray, radius: int, reach: int) -> tuple[np.ndarray, ...]:
    """Masks (own inside, own inside that visit outside, visitors inside, visitors outside)."""
    return d_own <= radius, (d_own <= radius) & (d_own > radius - reach), d_visit <= radius + reach, d_visit > radius - reach


def route(nodes: list[tuple], points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes of its own points, indexes of its visitors) for every shard that has any."""
    todo = [(0, np.arange(len(points)), np.empty(0, np.int64))]
    while todo:
        at, own, visit = todo.pop()
        node = nodes[at]
        if len(node) == 1:
            if len(own) or len(visit):
                yield node[0], own, visit
            continue
        inner, crossing, near, far = _sides(_bits(points[own], node[0]), _bits(points[visit], node[0]), node[1], reach)
        todo += [(node[2], own[inner], visit[near]), (node[3], own[~inner], np.concatenate([visit[far], own[crossing]]))]


def near_pairs(points: np.ndarray, visitors: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of the pairs of different values at most ``reach`` bits apart: points with points and with visitors."""
    rng = np.random.default_rng(11)
    todo = [(points, visitors)]
    while todo:
        p, q = todo.pop()
        if not len(p):
            continue
        split = _vantage(p, rng) if len(p) > LEAF_POINTS else None
        if split is None:
            q = np.concatenate([p, q])
            step = max(1, 2_000_000 // len(p))
            for i in range(0, len(q), step):
                d = np.bitwise_count(q[i:i + step, None] ^ p[None, :])
                x, y = np.nonzero((d <= reach) & (d > 0))
                if len(x):
                    yield q[i:i + step][x], p[y]
            continue
        v, radius = split
        inner, crossing, near, far = _sides(_bits(p, v), _bits(q, v), radius, reach)
        todo += [(p[inner], q[near]), (p[~inner], np.concatenate([q[far], p[crossing]]))]


def _shard_links(reach: int):
    def run(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        own = group.column("own").to_numpy(zero_copy_only=False)
        a, b, held = [], [], 0
        for x, y in near_pairs(fp[own], fp[~own], reach):
            a.append(x)
            b.append(y)
            held += len(x)
            if held > 1_000_000:                    # keep a forest, not the pairs
                x, y = spanning_forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
        x, y = spanning_forest(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64),) * 2
        return pa.table({"a": signed(x), "b": signed(y)})
    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (a, b) with the components of all pairs at most ``max_bits`` apart.

    ``distinct`` has one row per fingerprint (column ``fp``).
    """
    spark = distinct.sparkSession
    n = distinct.count()
    shards = max(1, -(-n // shard_points))
    nodes: list[tuple] = [(0,)]
    if shards > 1:
        want = min(SAMPLE_MAX, SAMPLE_PER_SHARD * shards)
        share = int(min(1.0, 1.2 * want / n) * 1_000_000)
        picked = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < share).limit(want).select("fp")
        sample = np.array([r["fp"] for r in picked.collect()], dtype=np.int64).view(np.uint64)   # SAMPLE_MAX at most
        nodes = build_tree(np.sort(sample), shards)
    tree = spark.sparkContext.broadcast(nodes)      # two nodes a sampled fingerprint at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for shard, own, visit in route(tree.value, fp, max_bits):
                idx = np.concatenate([own, visit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(idx), shard, np.int32)), signed(fp[idx]), pa.array(np.arange(len(idx)) < len(own))],
                    ["shard", "fp", "own"])

    sent = map_arrow(distinct.select("fp"), assign, "shard int, fp long, own boolean")
    return sent.groupBy("shard").applyInArrow(_shard_links(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) per row: the smallest id reachable over links of ``max_bits``."""
    rows = staged(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct, max_bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    component = rooted.join(lows, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(component, F.col("fp") == F.col("_fp")).select("id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """``docs`` with one row left of each group: the first by id (rows without id last), then text hash.

    Decisions go by (id, text hash), so rows that share an id, or have none,
    are told apart by their texts.  Of rows that repeat both one stays.
    """
    mark = F.xxhash64(text_col)
    named = docs.select(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), mark.alias("mark")).alias("id"),
                        F.col(text_col).alias("text"))
    groups = near_duplicates(named, "id", "text", **rules)
    kept = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(
        F.col("id.id").alias("_kept_id"), F.col("id.mark").alias("_kept_mark")).distinct()
    rows = docs.withColumn("_mark", mark)
    same = rows[id_col].eqNullSafe(kept["_kept_id"]) & (rows["_mark"] == kept["_kept_mark"])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "_mark"]).select(*docs.columns)

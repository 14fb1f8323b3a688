"""N-gram Jaccard self-join as a metric-space join with pivots.

Jaccard distance is a metric on the documents' shingle sets.  Equal sets are
one point.  Top regions: a single shingle is a pivot too, and a set can only
be near it if it holds it, so a point belongs to the regions of its rarest
shingles, as many as two linked sets cannot miss all of (of the ``2 a + 2``
smallest hashes of a set the ``a + 2`` rarest, if at most ``a`` of its
shingles may be missing in a linked set; the order is by the number of sets
that hold a shingle, then by hash).  Regions of equal members are one.

A region takes pivots among its points, those of the most cells first.  All
distances to them are exact, so the pivots' own links are known and they leave.
With r the link distance, a point at most r from its nearest pivot goes to that
pivot's Voronoi region, where all are of one component through the pivot; the
points far from all pivots are a region again.  What else may link to points of
a Voronoi region lies within 2 r of its pivot (triangle inequality): such
boundary points of other components are replicated there as visitors, and of
its own points only those can reach one that are at most r nearer to the pivot
than the nearest visitor.  Own points are held against visitors, the fewer of
the two being the pivots, until one side is used up or of one component.  In
the first round, what lies around the pivot that several regions have in common
is one region.
Regions that hold one component only are done, regions of equal members are
one, and all others are joined again with more pivots, until none is left.
Links are stars around pivots, never all pairs of a group.

Defined cases: a null text, or one without words, has an empty set and links
with nothing, itself included; fewer words than a shingle are one shingle;
repeated rows are one point; rows that share an id each have the component of
their own text; a component of rows without any id has a null component_id;
an empty table gives no rows.  Other columns are ignored.  Shingles are
compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import map_arrow, mix64, signed, staged, text_chunks
from murmur.llm.components import connected_components
from murmur.llm.passages import shingle_hashes, word_hashes

SHINGLE_WORDS = 5
MIN_PERCENT = 80
AROUND = 0.6                    # points of the first round's regions at most this far from one pivot are one region
PIVOTS = (1, 16, 256)           # pivots a region, round by round; then 16 times as many each round
CHUNK_CODES = 1_500_000         # shingles a task sends together
CHUNK_DOCS = 60_000
CODES_PER_BUCKET = 1_000_000
HOT = 16                        # a shingle of more sets of a chunk is sent once, with their number
NO_DOC = 65_535
SHINGLES_PER_BLOCK = 400_000    # sets held against one copy of a pivot
MAX_ROUNDS = 64
SENT = ["kind", "bucket", "chunk", "a", "b", "c", "d", "e", "id", "n", "k1", "k2", "mark"]
ENTRIES, HEAD, DOC = 0, 1, 2


# -- sets ----------------------------------------------------------------------------------
def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that a linked set may lack."""
    return n - (percent * n + 99) // 100


def pool_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of n, those of the smallest hashes, its rarest ones are taken from."""
    return np.minimum(n, 2 * missing(n, percent) + 2)


def shingle_sets(texts: list[str | None], shingle_words: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one after the other; set sizes)."""
    parts = []
    for t in texts:
        words = word_hashes(t, cache)
        sh = shingle_hashes(words, shingle_words if len(words) >= shingle_words else max(1, len(words)))
        sh.sort()
        parts.append(sh[np.concatenate([[True], sh[1:] != sh[:-1]])] if len(sh) else sh)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def digests(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, 2) 64-bit sums that tell the sets apart; zeros for empty ones."""
    out = np.zeros((len(sizes), 2), np.uint64)
    held = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[held]
    for k, seed in enumerate((21, 22)):
        if len(starts):
            out[held, k] = np.add.reduceat(mix64(sets, seed), starts)
    return out


# -- top regions ----------------------------------------------------------------------------
def _batch(kinds: dict, rows: int, id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int8(), pa.int32(), pa.int64(), *[pa.binary()] * 5, id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [kinds[c].cast(t) if isinstance(kinds.get(c), pa.Array) else pa.array(kinds[c], t) if c in kinds else pa.nulls(rows, t)
         for c, t in zip(SENT, types, strict=True)], SENT)


def _entries(codes: np.ndarray, docs: np.ndarray, width: int) -> tuple[list[tuple], tuple[np.ndarray, ...]]:
    """Sorted (bucket, codes, docs, weights) slices of a chunk, and its hot shingles (codes, sets, docs of them)."""
    order = np.argsort(codes, kind="stable")
    codes, docs = codes[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    length = np.diff(np.append(starts, len(codes)))
    hot = length > HOT
    in_hot = np.repeat(hot, length)
    sent = ~in_hot
    sent[starts[hot]] = True                            # once, in place of its sets
    weights = np.where(in_hot, np.repeat(length, length), 1)[sent].astype(np.uint32)
    at = np.where(in_hot, NO_DOC, docs)[sent].astype(np.uint16)
    hot_part = codes[starts[hot]], length[hot].astype(np.uint32), docs[in_hot].astype(np.uint16)
    codes = codes[sent]
    bucket = (codes // np.uint64(width)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    slices = [(int(b[0]), c, d, w) for b, c, d, w in
              zip(*(np.split(x, cuts) for x in (bucket, codes, at, weights)), strict=True)] if len(codes) else []
    return slices, hot_part


def _short(codes: np.ndarray, width: int) -> np.ndarray:
    """Place of a code within its bucket, as 32 bits."""
    return (codes % np.uint64(width) // np.uint64(-(-width >> 32))).astype(np.uint32)


def send_sets(docs: DataFrame, shingle_words: int, percent: int, buckets: int) -> DataFrame:
    """One scan: a row per document (id, n, k1, k2, mark), and the chunks' shingles for the buckets that count them."""
    width = (1 << 64) // buckets + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        codes, owners, heads, seen = [], [], [], {}
        held, chunk, id_type = 0, 0, None

        def flush() -> pa.RecordBatch:
            slices, (hot, lengths, members) = _entries(np.concatenate(codes), np.concatenate(owners), width)
            keys, n = np.concatenate([h[0] for h in heads]), np.concatenate([h[1] for h in heads])
            rows = len(slices) + 1
            cells = (hot // np.uint64(width) << np.uint64(32)) | _short(hot, width)
            return _batch({
                "kind": [ENTRIES] * len(slices) + [HEAD], "bucket": [s[0] for s in slices] + [chunk % buckets], "chunk": [chunk] * rows,
                "a": [_short(s[1], width).tobytes() for s in slices] + [keys.tobytes()],
                "b": [s[2].tobytes() for s in slices] + [n.astype(np.int32).tobytes()],
                "c": [s[3][s[2] == NO_DOC].tobytes() for s in slices] + [cells.tobytes()],
                "d": [None] * len(slices) + [lengths.tobytes()], "e": [None] * len(slices) + [members.tobytes()]}, rows, id_type)

        for batch in batches:
            id_type, first = batch.column("id").type, batch.column("task")[0].as_py() << 33 if batch.num_rows else 0
            chunk = max(chunk, first)
            for i, j in text_chunks(batch, "text"):
                sets, sizes = shingle_sets(batch.column("text")[i:j].to_pylist(), shingle_words, cache)
                keys = digests(sets, sizes)
                yield _batch({"kind": [DOC] * (j - i), "id": batch.column("id")[i:j], "n": sizes.tolist(), "k1": signed(keys[:, 0]),
                              "k2": signed(keys[:, 1]), "mark": batch.column("mark")[i:j]}, j - i, id_type)
                new = np.zeros(j - i, bool)                                     # sets that the chunk does not hold yet
                number = np.zeros(j - i, np.int64)
                for r, key in enumerate(map(bytes, keys)):
                    if sizes[r] and key not in seen:
                        new[r], number[r] = True, len(seen)
                        seen[key] = None
                starts = np.cumsum(sizes) - sizes
                place = np.arange(len(sets)) - np.repeat(starts, sizes)
                pool = pool_size(sizes, percent) * new
                take = place < np.repeat(pool, sizes)
                codes.append(mix64(sets[take], 7))
                owners.append(np.repeat(number, sizes)[take])
                heads.append((keys[new], sizes[new]))
                held += int(take.sum())
                if held > CHUNK_CODES or len(seen) > CHUNK_DOCS - 2_000:
                    yield flush()
                    codes, owners, heads, seen = [], [], [], {}
                    held, chunk = 0, chunk + 1
        if seen:
            yield flush()

    id_type = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs.select("id", "text", F.xxhash64("text").alias("mark"), F.spark_partition_id().cast("long").alias("task")), run,
                     f"kind tinyint, bucket int, chunk long, a binary, b binary, c binary, d binary, e binary, id {id_type}, "
                     "n int, k1 long, k2 long, mark long")


def _arrays(group: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in group.column(column).to_pylist()]


def count_codes(group: pa.Table) -> pa.Table:
    """A bucket's shingles of two sets or more, with the grade of their number, back to their chunks; heads pass."""
    heads = group.filter(pa.compute.equal(group.column("kind"), HEAD)).select(["chunk", "bucket", "a", "b", "c", "d", "e"])
    rest = group.filter(pa.compute.equal(group.column("kind"), ENTRIES))
    out = [heads.append_column("head", pa.array([True] * heads.num_rows, pa.bool_()))]
    if rest.num_rows:
        codes, docs, hot = _arrays(rest, "a", np.uint32), _arrays(rest, "b", np.uint16), _arrays(rest, "c", np.uint32)
        size = np.array([len(c) for c in codes])
        every, at = np.concatenate(codes), np.concatenate(docs)
        weight = np.ones(len(every), np.int64)
        weight[at == NO_DOC] = np.concatenate(hot)
        values, inverse = np.unique(every, return_inverse=True)
        n = np.bincount(inverse, weight, len(values)).astype(np.int64)[inverse]
        keep = n > 1
        grade = np.minimum(255, np.floor(4 * np.log2(np.maximum(n, 1)) + 1e-9)).astype(np.uint8)
        ends = np.cumsum(size)
        rows = [(x, y, every[s:e][k].tobytes(), at[s:e][k].tobytes(), grade[s:e][k].tobytes())
                for x, y, s, e in zip(rest.column("chunk").to_pylist(), rest.column("bucket").to_pylist(), ends - size, ends, strict=True)
                if (k := keep[s:e]).any()]
        if rows:
            x, y, a, b, c = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.binary())
            out.append(pa.table({"chunk": pa.array(x, pa.int64()), "bucket": pa.array(y, pa.int32()), "a": pa.array(a, pa.binary()),
                                 "b": pa.array(b, pa.binary()), "c": pa.array(c, pa.binary()), "d": none, "e": none,
                                 "head": pa.array([False] * len(rows), pa.bool_())}))
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def rarest_cells(percent: int):
    """A chunk's points with the cells of their rarest shingles that other sets hold too; points without any are left out."""
    def run(group: pa.Table) -> pa.Table:
        is_head = group.column("head").to_numpy(zero_copy_only=False)
        head, rest = group.filter(pa.array(is_head)), group.filter(pa.array(~is_head))
        keys, n = _arrays(head, "a", np.uint64)[0].reshape(-1, 2), _arrays(head, "b", np.int32)[0].astype(np.int64)
        hot, lengths, members = (_arrays(head, c, t)[0] for c, t in (("c", np.uint64), ("d", np.uint32), ("e", np.uint16)))
        cells, docs, grades = (np.empty(0, t) for t in (np.uint64, np.int64, np.uint8))
        if rest.num_rows:
            short = _arrays(rest, "a", np.uint32)
            bucket = np.repeat(rest.column("bucket").to_numpy().astype(np.uint64), [len(s) for s in short])
            cells = bucket << np.uint64(32) | np.concatenate(short).astype(np.uint64)
            docs = np.concatenate(_arrays(rest, "b", np.uint16)).astype(np.int64)
            grades = np.concatenate(_arrays(rest, "c", np.uint8))
        if len(hot):                                                            # hot shingles: a row for each of their sets
            once = docs == NO_DOC
            found, first = np.unique(cells[once], return_index=True)
            grade = grades[once][first][np.searchsorted(found, hot)]
            cells = np.concatenate([cells[~once], np.repeat(hot, lengths)])
            docs, grades = np.concatenate([docs[~once], members.astype(np.int64)]), np.concatenate([grades[~once], np.repeat(grade, lengths)])
        order = np.lexsort((cells, grades, docs))
        cells, docs = cells[order], docs[order]
        shared = np.bincount(docs, minlength=len(n))
        lost = missing(n, percent)
        alone = pool_size(n, percent) - shared                            # shingles that no other set holds
        place = np.arange(len(docs)) - (np.cumsum(shared) - shared)[docs]
        take = place < np.minimum(shared, np.maximum(lost + 2 - alone, 0))[docs]
        cells, docs = cells[take], docs[take]
        order = np.lexsort((cells, docs))
        cells, docs = cells[order], docs[order]
        new = np.ones(len(docs), bool)
        new[1:] = (cells[1:] != cells[:-1]) | (docs[1:] != docs[:-1])
        cells, docs = cells[new], docs[new]
        held, count = np.unique(docs, return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.table({"k1": signed(keys[held, 0]), "k2": signed(keys[held, 1]), "n": pa.array(n[held], pa.int64()),
                         "cells": pa.ListArray.from_arrays(pa.array(offsets), signed(cells))})
    return run


def once_each(members: DataFrame, name: str) -> DataFrame:
    """The rows of regions that have something to join, those of equal members once.

    (region, pid, n, rank, home, own, turn): ``home`` is the pivot of a Voronoi
    region, ``own`` tells its own points from visitors; without home all points
    are held against each other.  The points of turn 0 may become pivots.
    """
    held = staged(members, name)
    mark = ("pid", "own", "turn")
    sums = (held.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64(*mark)).alias("x1"),
                                       F.bit_xor(F.xxhash64(F.lit(1), *mark)).alias("x2"),
                                       F.min("turn").alias("first"), F.max("turn").alias("last"), F.max("home").alias("of"))
            .filter("members > 1 and first = 0 and (of is null or last = 1)"))
    kept = sums.groupBy("members", "x1", "x2").agg(F.min("region").alias("at"))
    return staged(held.join(kept.select("at"), F.col("region") == F.col("at")).drop("at"), name)


def top_regions(points: DataFrame) -> DataFrame:
    """The regions of the cells."""
    return once_each(points.select(F.explode("cells").alias("region"), "pid", "n", (-F.size("cells")).alias("rank"),
                                   F.lit(None).cast("long").alias("home"), F.lit(True).alias("own"), F.lit(0).alias("turn")), "join-top")


# -- distances ---------------------------------------------------------------------------------
def distances(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(at, pid, pivot, both, either): exact sizes of intersection and union of points and pivots that meet.

    ``asked``: (at, pid, n, is_pivot, mutual); all points and pivots with equal
    ``at`` meet.  Points and pivots are dealt over blocks of a bounded number
    of shingles, and each block of points meets each of pivots.  A block
    returns links that span its components and, if ``mutual``, each point's
    nearest pivot and the pairs of different components that are at most the
    link distance beyond the pivot's farthest own point (of several blocks: at
    most twice the link distance).  Of one block only, own points of a pivot
    without such visitors are done and left out.
    """
    sizes = asked.groupBy(F.col("at").alias("of")).agg(
        F.ceil(F.sum(F.when(F.col("is_pivot"), F.col("n"))) / SHINGLES_PER_BLOCK).alias("pivot_blocks"),
        F.ceil(F.sum(F.when(~F.col("is_pivot"), F.col("n"))) / SHINGLES_PER_BLOCK).alias("point_blocks")).dropna()
    share = lambda n: F.array(F.pmod(F.xxhash64("pid"), F.col(n)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    dealt = (asked.join(sizes, F.col("at") == F.col("of"))
             .withColumn("x", F.explode(F.when(F.col("is_pivot"), every("point_blocks")).otherwise(share("point_blocks"))))
             .withColumn("y", F.explode(F.when(F.col("is_pivot"), share("pivot_blocks")).otherwise(every("pivot_blocks")))))

    r = 1 - percent / 100 + 1e-9

    def measure(group: pa.Table) -> pa.Table:
        pid, is_pivot = group.column("pid").to_numpy(), group.column("is_pivot").to_numpy(zero_copy_only=False)
        values = _arrays(group, "set", np.uint64)
        points, pivots = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)
        size = np.array([len(values[k]) for k in points], np.int64)
        out = [np.empty((4, 0), np.int64)]
        if len(points) and len(pivots):
            words, number = np.unique(np.concatenate([values[k] for k in points]), return_inverse=True)
            starts, held = np.cumsum(size) - size, np.zeros(len(words), bool)
            whole, nearest, own = bool(group.column("whole")[0].as_py()), np.full(len(points), 2.0), np.zeros(len(points), np.int64)
            found = []
            for k in sorted(pivots, key=lambda k: pid[k]):
                at = np.searchsorted(words, values[k])
                at = at[words[np.minimum(at, len(words) - 1)] == values[k]]
                held[at] = True
                both = np.add.reduceat(held[number], starts, dtype=np.int64)
                held[at] = False
                d = np.where(pid[points] == pid[k], 2.0, 1 - both / (size + len(values[k]) - both))
                closer = d < nearest
                nearest, own = np.where(closer, d, nearest), np.where(closer, k, own)
                some = np.flatnonzero(d <= 2 * r)
                found.append((k, some, both[some], d[some]))
                last = both if not found[:-1] else np.where(closer, both, last)
            lengths = np.array([len(v) for v in values], np.int64)

            def emit(at_points: np.ndarray, k, both: np.ndarray) -> None:
                out.append(np.stack([pid[points[at_points]], np.broadcast_to(pid[k], len(both)), both, size[at_points] + lengths[k] - both]))

            # components of this block: of the links only those that join two are sent
            node = np.unique(pid, return_inverse=True)[1]
            component = np.arange(node.max() + 1)
            for k, some, both, d in found:
                near = np.flatnonzero(d <= r)
                joined, first = np.unique(component[node[points[some[near]]]], return_index=True)
                first = near[first[joined != component[node[k]]]]
                emit(some[first], k, both[first])
                joined = np.append(joined, component[node[k]])
                component[np.isin(component, joined)] = joined.min()
            if group.column("mutual")[0].as_py():
                wanted = nearest < 2
                for k, some, both, d in found:
                    mine = (own[some] == k) & (d <= r)
                    reach = d[mine].max() + r if whole and mine.any() else -1.0 if whole else 2 * r
                    keep = (d <= reach) & (own[some] != k) & (component[node[points[some]]] != component[node[k]])
                    emit(some[keep], k, both[keep])
                    if whole and not keep.any():            # no visitor: its own points are done
                        wanted[some[mine]] = False
                some = np.flatnonzero(wanted)
                emit(some, own[some], last[some])
        rows = np.concatenate(out, axis=1)
        return pa.table({"at": pa.array(np.full(rows.shape[1], group.column("at")[0].as_py(), np.int64)),
                         **{c: pa.array(v) for c, v in zip(("pid", "pivot", "both", "either"), rows, strict=True)}})

    whole = ((F.col("point_blocks") == 1) & (F.col("pivot_blocks") == 1)).alias("whole")
    fetched = dealt.select("at", "x", "y", "pid", "is_pivot", "mutual", whole).join(
        sets.select(F.col("pid").alias("set_of"), "set"), F.col("pid") == F.col("set_of"))
    return fetched.select("at", "x", "y", "pid", "is_pivot", "mutual", "whole", "set").groupBy("at", "x", "y").applyInArrow(
        measure, "at long, pid long, pivot long, both long, either long")


def is_link(percent: int) -> Column:
    return F.col("both") * 100 >= F.col("either") * percent


def region_pivots(members: DataFrame, k: int) -> DataFrame:
    """(at, pivot): the k first points of each region that may become pivots."""
    able = members.filter("turn = 0")
    if k == 1:
        first = F.min(F.struct("rank", F.xxhash64(F.lit(3), "pid").alias("mark"), F.col("pid").alias("pid")))
        return able.groupBy(F.col("region").alias("at")).agg(first.alias("first")).select("at", F.col("first.pid").alias("pivot"))
    order = Window.partitionBy("region").orderBy("rank", F.xxhash64(F.lit(3), "pid"), "pid")
    return (able.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
            .select(F.col("region").alias("at"), F.col("pid").alias("pivot")))


def voronoi(measured: DataFrame, percent: int, merge: bool) -> DataFrame:
    """Regions of the (region, pid, n, rank, pivot, both, either) rows of points without home, with their distance ``d``.

    ``merge``: of the regions with one pivot the points ``AROUND`` it are one;
    those that may link to a point beyond are with both.
    """
    r = 1 - percent / 100 + 1e-9
    d = 1 - F.col("both") / F.col("either")
    seen = measured.select("region", "pid", "n", "rank", "pivot", d.alias("d")).withColumn(
        "near", F.min(F.struct("d", "pivot")).over(Window.partitionBy("region", "pid")))        # a row for each pivot of the region
    at = [F.lit(-2)] if merge else [F.lit(-2), F.col("region")]
    inside = seen.filter(F.col("d") <= 2 * r).select(
        F.xxhash64("pivot", *at).alias("region"), "pid", "n", "rank", F.col("pivot").alias("home"),
        ((F.col("near.pivot") == F.col("pivot")) & (F.col("d") <= r)).alias("own"), "d")
    inside = inside.join(inside.filter("own").select(F.col("region").alias("held")).distinct(), F.col("region") == F.col("held"), "left_semi")
    mutual = ["pid", "n", "rank", F.lit(None).cast("long").alias("home"), F.lit(True).alias("own"), F.lit(0.0).alias("d")]
    far = seen.filter((F.col("near.d") > r) & (F.col("near.pivot") == F.col("pivot")))
    beyond = far.filter(F.col("d") > AROUND - r) if merge else far
    out = inside.union(beyond.select(F.xxhash64("region", F.lit(-1)).alias("region"), *mutual))
    if merge:
        out = out.union(far.filter(F.col("d") <= AROUND).select(F.xxhash64("pivot", F.lit(-3)).alias("region"), *mutual)).distinct()
    return out


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` plus the component of the point and of the home."""
    of_pid, of_home = (roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"{c}_root")) for c in ("pid", "home"))
    joined = rows.join(of_pid, F.col("pid") == F.col("_pid"), "left").join(of_home, F.col("home") == F.col("_home"), "left")
    return joined.select(*rows.columns, F.coalesce("pid_root", "pid").alias("root"), F.coalesce("home_root", "home").alias("home_root"))


def next_regions(members: DataFrame, pivots: DataFrame, found: DataFrame, roots: DataFrame, percent: int, merge: bool) -> DataFrame:
    """The members of the next round."""
    r = 1 - percent / 100 + 1e-9
    left = members.join(pivots, (F.col("region") == F.col("at")) & (F.col("pid") == F.col("pivot")), "left_anti")
    if merge:                                           # measured by pivot, not by region
        told = found.select(F.col("pid").alias("x"), F.col("at").alias("y"), "pivot", "both", "either")
        named = left.join(pivots.select("at", F.col("pivot").alias("of")), F.col("region") == F.col("at"))
        measured = named.join(told, (F.col("pid") == F.col("x")) & (F.col("of") == F.col("y")))
    else:
        told = found.select(F.col("pid").alias("x"), F.col("at").alias("y"), "pivot", "both", "either")
        measured = left.filter("home is null").join(told, (F.col("pid") == F.col("x")) & (F.col("region") == F.col("y")))
    placed = with_roots(voronoi(measured, percent, merge), roots).filter("home is null or own or root <> home_root")
    visitor = ~F.col("own")
    sums = placed.groupBy(F.col("region").alias("at")).agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.when(F.col("own"), 1)).alias("n_own"),
        F.count(F.when(visitor, 1)).alias("n_visitors"), F.min(F.when(visitor, F.col("d"))).alias("nearest")).filter("low < high")
    first = F.when(F.col("own") == (F.col("n_own") <= F.col("n_visitors")), 0).otherwise(1)
    new = (placed.join(sums, F.col("region") == F.col("at")).filter(F.col("home").isNull() | visitor | (F.col("d") >= F.col("nearest") - r))
           .select("region", "pid", "n", "rank", "home", "own", F.when(F.col("home").isNull(), 0).otherwise(first).alias("turn")))
    old = with_roots(left.filter("home is not null"), roots).filter("own or root <> home_root").select(*members.columns)
    return new.union(old)


def links(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all points that a link joins to another, by rounds of pivots."""
    spark, members, k = regions.sparkSession, regions, 0
    roots = spark.createDataFrame([], "node long, root long")
    for turn in range(MAX_ROUNDS):
        if members.isEmpty():
            return roots
        k = PIVOTS[turn] if turn < len(PIVOTS) else 16 * k
        pivots = staged(region_pivots(members, k), "join-pivots")
        met = members.join(pivots, F.col("region") == F.col("at"))
        if turn == 0:                                   # one pivot a region: regions with the same one measure together
            asked = met.select(F.col("pivot").alias("at"), "pid", "n", (F.col("pid") == F.col("pivot")).alias("is_pivot"),
                               F.lit(True).alias("mutual")).distinct()
        else:
            points = members.filter("home is null or turn = 1").select(F.col("region").alias("at"), "pid", "n", F.lit(False).alias("is_pivot"),
                                                                              F.col("home").isNull().alias("mutual"))
            asked = points.union(met.filter("pid = pivot").select(
                "at", "pid", "n", F.lit(True).alias("is_pivot"), F.col("home").isNull().alias("mutual")))
        found = staged(distances(asked, sets, percent), "join-distances")
        new = found.filter(is_link(percent)).select(F.col("pid").alias("a"), F.col("pivot").alias("b"))
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))            # stars of the links so far
        roots = staged(connected_components(known.union(new)), "join-roots")
        members = once_each(next_regions(members, pivots, found, roots, percent, turn == 0), "join-regions")
    raise RuntimeError(f"regions did not settle in {MAX_ROUNDS} rounds")


# -- join ---------------------------------------------------------------------------------------
def point_sets(docs: DataFrame, doc_rows: DataFrame, points: DataFrame, shingle_words: int) -> DataFrame:
    """(pid, set): sorted shingle hashes of each point, from the text of one of its documents."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("mark").alias("mark"))).alias("at")
    chosen = (doc_rows.join(points.select("pid", F.col("k1").alias("p1"), F.col("k2").alias("p2")),
                            (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
              .groupBy("pid", "k1", "k2").agg(first).select("pid", "k1", "k2", F.col("at.id").alias("at_id"), F.col("at.mark").alias("at_mark")))
    texts = docs.select("id", "text", F.xxhash64("text").alias("mark"))
    found = texts.join(chosen, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("mark") == F.col("at_mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for i, j in text_chunks(batch, "text"):
                sets, sizes = shingle_sets(batch.column("text")[i:j].to_pylist(), shingle_words, cache)
                keys = digests(sets, sizes).view(np.int64)
                same = ((keys[:, 0] == batch.column("k1")[i:j].to_numpy()) & (keys[:, 1] == batch.column("k2")[i:j].to_numpy()))
                parts = np.split(sets, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("pid")[i:j].filter(pa.array(same)), pa.array([p.tobytes() for p, ok in zip(parts, same, strict=True) if ok], pa.binary())],
                    ["pid", "set"])

    return map_arrow(found.select("pid", "k1", "k2", "text"), run, "pid long, set binary").dropDuplicates(["pid"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                       min_percent: int = MIN_PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) per row: the smallest id reachable over links of ``min_percent`` (51 to 100)."""
    if not 51 <= min_percent <= 100:
        raise ValueError("min_percent must be from 51 to 100")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = staged(send_sets(texts, shingle_words, min_percent, max(8, int(chars / 6 * 2 * (1 - min_percent / 100)) // CODES_PER_BUCKET)),
                  "join-sent")
    doc_rows = sent.filter(F.col("kind") == DOC).select("id", "n", "k1", "k2", "mark")
    replies = (sent.filter(F.col("kind") != DOC).select("kind", "bucket", "chunk", "a", "b", "c", "d", "e").groupBy("bucket")
               .applyInArrow(count_codes, "chunk long, bucket int, a binary, b binary, c binary, d binary, e binary, head boolean"))
    cells = replies.groupBy("chunk").applyInArrow(rarest_cells(min_percent), "k1 long, k2 long, n long, cells array<long>")
    points = staged(cells.dropDuplicates(["k1", "k2"]).withColumn("pid", F.monotonically_increasing_id()), "join-points")
    regions = top_regions(points)
    live = points.join(regions.select(F.col("pid").alias("live")).distinct(), F.col("pid") == F.col("live"), "left_semi")
    sets = staged(point_sets(texts, doc_rows, live, shingle_words), "join-sets")
    roots = links(regions, sets, min_percent)

    linked = points.join(roots, F.col("pid") == F.col("node")).select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), "root")
    groups = doc_rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("low"))
    rooted = groups.join(linked, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
    lows = rooted.filter("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("low").alias("lowest"))
    named = rooted.join(lows, F.col("root") == F.col("of"), "left").select(
        F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("lowest"))
    return doc_rows.join(named, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")).alias("component_id"))

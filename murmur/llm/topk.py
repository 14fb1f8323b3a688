"""Exact top-k Hamming search by incremental multi-index hashing.

Embeddings become binary codes (the sign of each number).  The rows are dealt
over shards of bounded size; each shard indexes the segments of its codes
(sorted values, one table a segment) and answers every query block.  A query
probes the segment values within a growing radius: after all segments were
probed to radius r, every code within ``m (r + 1) - 1`` bits of the query has
been seen, so the search ends once the k-th verified distance is covered.
The shards' answers are merged by an aggregation.

Defined cases: a null embedding has no code, so it is neither found nor
answered; a null or NaN number is a 0 bit; codes are as long as the longest
embedding (in words of 64 bits), shorter ones fill up with 0 bits; a query
never finds a row of its own id; repeated rows are found each; ties go to the smaller id; fewer
than k rows give fewer answers; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import map_arrow, signed, staged

SEGMENT_BITS = 8
K = 10
SHARD_ROWS = 65_536
QUERY_BLOCK = 4_096


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int | None = None) -> DataFrame:
    """(id, code): bit i of the code (words of 64 bits) is set where number i is positive.

    ``bits`` is the length to compare; by default that of the longest embedding.
    """
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"),
                                                                F.col(vector_col).alias("v"))
    if bits is None:
        bits = rows.agg(F.max(F.size("v"))).first()[0] or 1
    words = max(1, -(-bits // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("v")
            lengths = pc.list_value_length(vecs).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(vecs.flatten(), 0.0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            sizes = np.minimum(lengths, bits)
            codes = np.zeros((len(vecs), words), np.uint64)
            for i in range(int(sizes.max(initial=0))):
                has = np.flatnonzero(sizes > i)
                codes[has, i // 64] |= (flat[starts[has] + i] > 0).astype(np.uint64) << np.uint64(i % 64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), code_lists(codes)], ["id", "code"])

    return map_arrow(rows, run, "id long, code array<long>")


def code_lists(codes: np.ndarray) -> pa.Array:
    """Rows of uint64 words as a list column."""
    n, words = codes.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words), signed(codes.reshape(-1)))


def code_words(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of codes as rows of uint64 words (all codes of a table are equally long)."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy().view(np.uint64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


class SegmentIndex:
    """Multi-index hash of codes: rows of each segment sorted by the segment's value."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, segment_bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes, self.width = ids[order], codes[order], segment_bits
        self.in_word = 64 // segment_bits
        self.m = codes.shape[1] * self.in_word
        self.tables = []
        for s in range(self.m):
            values = self.segment(self.codes, s)
            rows = np.argsort(values, kind="stable")
            counts = np.bincount(values, minlength=1 << self.width)
            self.tables.append((rows, np.concatenate([[0], np.cumsum(counts)])))
        self.flips = [np.array([sum(1 << b for b in c) for c in combinations(range(self.width), r)], np.int64)
                      for r in range(self.width + 1)]

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        word, place = divmod(s, self.in_word)
        return ((codes[:, word] >> np.uint64(place * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, own: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest codes of other ids, by distance and id."""
        seen = np.zeros(len(self.codes), bool)
        rows, dist = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(self.width + 1):
            for s in range(self.m):
                order, bounds = self.tables[s]
                probes = int(self.segment(code[None, :], s)[0]) ^ self.flips[radius]
                lo, n = bounds[probes], bounds[probes + 1] - bounds[probes]
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                lo, n = lo[some], n[some]
                found = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                found = found[~seen[found]]
                seen[found] = True
                found = found[self.ids[found] != own]
                d = np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64)
                rows, dist = np.concatenate([rows, found]), np.concatenate([dist, d])
                if len(rows) > k:                               # rows are in id order
                    best = np.lexsort((rows, dist))[:k]
                    rows, dist = rows[best], dist[best]
                # segments up to s were probed to this radius, the others to one less
                if len(rows) >= k and dist.max() <= self.m * radius + s:
                    return self.ids[rows], dist
        best = np.lexsort((rows, dist))
        return self.ids[rows[best]], dist[best]


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, segment_bits: int = SEGMENT_BITS,
          shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the ``k`` nearest codes of every query.

    ``codes`` and ``queries`` have columns ``id`` and ``code``.  Queries are
    dealt in blocks; every (shard, block) pair is one task's work, so neither
    side has to fit anywhere whole.
    """
    n_rows, n_queries = codes.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // query_block))
    deal = lambda df, n: F.pmod(F.xxhash64("id", "code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select(deal(codes, shards).alias("shard"), every(blocks).alias("block"), "id", "code")
    right = queries.select(every(shards).alias("shard"), deal(queries, blocks).alias("block"), "id", "code")

    def answer(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            index = SegmentIndex(rows.column("id").to_numpy(), code_words(rows.column("code")), segment_bits)
            for q, c in zip(asked.column("id").to_numpy(), code_words(asked.column("code")), strict=True):
                ids, dist = index.search(q, c, k)
                out.append((np.full(len(ids), q), np.repeat(c[None, :], len(ids), axis=0), ids, dist))
        q, c, i, d = ((np.concatenate(x) for x in zip(*out, strict=True)) if out
                      else (np.empty(0, np.int64), np.empty((0, 1), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)))
        return pa.table({"query_id": pa.array(q, pa.int64()), "query_code": code_lists(c), "neighbor_id": pa.array(i, pa.int64()),
                         "distance": pa.array(d, pa.int32())})

    found = (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
             .applyInArrow(answer, "query_id long, query_code array<long>, neighbor_id long, distance int"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k)     # k a shard
    return (found.groupBy("query_id", "query_code").agg(best.alias("best"))
            .select("query_id", F.posexplode("best").alias("pos", "hit"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), "hit.neighbor_id", "hit.distance"))


def search_vectors(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding",
                   k: int = K) -> DataFrame:
    """Top-k of every row of ``vectors`` for which ``is_query`` (on ``id``) holds, among all rows."""
    codes = staged(sign_codes(vectors, id_col, vector_col), "codes")
    return top_k(codes, codes.filter(is_query), k)

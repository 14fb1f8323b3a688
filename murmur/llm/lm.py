"""Bigram language model held in a log-frequency Bloom filter.

Counts cover every training text.  A word or bigram seen c >= ``min_count`` times
(1: every one; 2: the usual cut-off of one) has level floor(2 log2 c); the filter
holds one key for each level from the lowest up to its own, and the level is read back
by probing the lowest, the next, ... until a probe misses.  The filter is built in buckets of the code
space, where the counts meet, each of as many segments as its keys need.  If all n-grams of the training
texts must fit ``MAX_FILTER_BYTES``, they are assembled on the driver and broadcast.  If not, the texts are dealt
to chunks, and a chunk sends each of its distinct codes once, with its count in the chunk's training
texts: the bucket adds up the counts, fills its part of the filter, probes it and answers the chunks.
What is sent is in proportion to the texts, whatever their number.  Both forms have the same segments and
cut-off, so the same scores.
Probabilities are Dirichlet-smoothed,

    p(w | v) = (c(v w) + K p(w)) / (c(v) + K),  p(w) = (c(w) + 1) / (N + V + 1),

with the counts as the filter gives them.

The base score uses exact counts: the ``HEAD_WORDS`` most frequent tokens are
broadcast, all other tokens are joined with the count table.

Defined cases: a null or empty text is the end token alone; rows without id
are training rows; repeated rows count as often as they occur; without
training rows N = V = 0 and every token scores log10 1 = 0; an empty table
gives no rows.  Words are bytes, the end token is the empty byte string.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import END, map_arrow, mix64, numbered, signed, staged, text_chunks

HEAD_WORDS = 300_000
MIN_COUNT = 2                       # n-grams seen less often are not held; 1 holds all
MIN_LEVEL = 2                       # floor(2 log2 c) of MIN_COUNT
NOT_HELD, NO_CHUNK = -1, -1
PRIOR = 100.0                       # K: counts the unigram prior is worth
BITS_PER_KEY, HASHES = 10, 6
KEYS_PER_COUNT = 1.5                # at most: an n-gram seen twice has three levels
SEGMENT_BITS = 1 << 20              # a power of two
MAX_FILTER_BYTES = 48 << 20
CODES_PER_BUCKET = 1_200_000
FLUSH_CODES = 4_000_000
MAX_LEVEL = 96
COUNT_CHARS = 8_000_000             # texts whose words are counted together
CHUNK_CHARS = 4_000_000             # texts whose distinct codes are probed together
SENT = "bucket int, chunk long, codes binary, counts binary"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def unigram_codes(h: np.ndarray) -> np.ndarray:
    return mix64(h, 1)


def bigram_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(first, 2) * np.uint64(0x9FB21C651E98DF25) + second, 3)


def previous(numbers: np.ndarray) -> np.ndarray:
    """The token before each one; the end token stands before a text's first."""
    return np.concatenate([[0], numbers[:-1]])


def _word_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_chunks(batch, "text", COUNT_CHARS):
                words, numbers, _ = numbered(batch.column("text")[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(numbers, minlength=len(words)))],
                                                 ["token", "n"])

    return map_arrow(texts, run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The range of the code space each code lies in."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(codes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, its part) of sorted codes."""
    bucket = bucket_of(codes, buckets)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(codes)]
    return ((int(bucket[i]), slice(i, j)) for i, j in itertools.pairwise(cuts) if j > i)


def planes(sorted_codes: np.ndarray) -> bytes:
    """The gaps of sorted codes, byte by byte of all: the high bytes are zero, so Spark's compression drops them."""
    return np.diff(sorted_codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64)


def _counted(codes: np.ndarray, counts: np.ndarray, buckets: int, chunk: int = NO_CHUNK) -> pa.RecordBatch:
    """(bucket, chunk, codes, counts) of sorted codes; a few small counts in any order, which Spark's compression would leave long."""
    parts = [(b, chunk, planes(codes[at]), zlib.compress(counts[at].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
             for b, at in by_bucket(codes, buckets)]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in parts], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                      ["bucket", "chunk", "codes", "counts"])


def _parts_of(group: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The codes and the counts of each (bucket, chunk, codes, counts) row."""
    return ([from_planes(x.as_py()) for x in group.column("codes")],
            [np.ascontiguousarray(np.frombuffer(zlib.decompress(x.as_py()), np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for x in group.column("counts")])


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, the sums of their counts, the place among them of each code given)."""
    given = np.concatenate(codes)
    order = np.argsort(given, kind="stable")
    given = given[order]
    first = np.concatenate([[True], given[1:] != given[:-1]])
    place = np.empty(len(given), np.int64)
    place[order] = np.cumsum(first) - 1
    return given[first], np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], np.flatnonzero(first)), place


def _code_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, codes, counts) of words and bigrams, to be added up by bucket; they belong to no chunk.

    Tasks send sorted arrays of codes to the buckets of the code space, not a
    row a code; one bucket holds about ``CODES_PER_BUCKET`` of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for i, j in text_chunks(batch, "text"):
                words, numbers, _ = numbered(batch.column("text")[i:j])
                h = word_hashes(words)
                held += [unigram_codes(h)[numbers], bigram_codes(h[previous(numbers)], h[numbers])]
                if sum(map(len, held)) > FLUSH_CODES:
                    yield _counted(*np.unique(np.concatenate(held), return_counts=True), buckets)
                    held = []
        if held:
            yield _counted(*np.unique(np.concatenate(held), return_counts=True), buckets)

    return map_arrow(texts, run, SENT)


def segment_of(codes: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Segment of each code among the ``segments`` of its bucket."""
    return ((codes >> np.uint64(32)) % segments.astype(np.uint64)).astype(np.int64)


def _seeds(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    e = mix64(codes, 100 + level)
    return e & np.uint64(0xFFFFFFFF), (e >> np.uint64(32)) | np.uint64(1)


def _position(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    """Bit of the i-th hash function of a key within its segment."""
    return ((a + np.uint64(i) * b) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


class Filter:
    """Log-frequency Bloom filter; ``bits`` is one byte array of whole segments, ``sizes`` the segments of each bucket in turn."""

    def __init__(self, bits: np.ndarray, min_level: int, sizes: np.ndarray | None = None):
        self.bits, self.min_level = bits, min_level
        self.sizes = np.array([len(bits) * 8 // SEGMENT_BITS]) if sizes is None else sizes

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """Level of each code (``NOT_HELD``: in no training text): membership probes, level after level, in its segment."""
        out = np.full(len(codes), NOT_HELD)
        bucket = bucket_of(codes, len(self.sizes))
        size = self.sizes[bucket]
        base = ((np.cumsum(self.sizes) - self.sizes)[bucket] + segment_of(codes, np.maximum(size, 1))) * (SEGMENT_BITS // 8)
        alive = np.flatnonzero(size > 0)
        for level in range(self.min_level, MAX_LEVEL):
            a, b = _seeds(codes[alive], level)
            for i in range(HASHES):                 # a key that misses one probe needs no other
                at = _position(a, b, i)
                hit = (self.bits[base[alive] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
                alive, a, b = alive[hit], a[hit], b[hit]
            if not len(alive):
                break
            out[alive] = level
        return out


def expected_counts(none: float, low: int = MIN_LEVEL) -> np.ndarray:
    """Middle count of each level; ``none``, the last, for n-grams that are not held."""
    first = np.ceil(2.0 ** (np.arange(MAX_LEVEL + 1) / 2) - 1e-9)
    middle = (first[:-1] + np.maximum(first[1:] - 1, first[:-1])) / 2
    return np.append(np.where(np.arange(MAX_LEVEL) >= low, middle, none), none)


def filled(codes: np.ndarray, counts: np.ndarray, low: int) -> np.ndarray:
    """The bits of a bucket's codes, as many segments as their keys need; none without a key."""
    codes, counts = codes[counts > 0], counts[counts > 0]
    levels = np.minimum(np.floor(2 * np.log2(counts) + 1e-9), MAX_LEVEL - 1).astype(np.int64)
    segments = -(-int(np.maximum(levels - low + 1, 0).sum()) * BITS_PER_KEY // SEGMENT_BITS)
    if not segments:
        return np.zeros(0, np.uint8)
    bits = np.zeros(segments * SEGMENT_BITS, np.uint8)
    base = segment_of(codes, np.array(segments)) * SEGMENT_BITS
    for lv in range(low, int(levels.max()) + 1):
        held = levels >= lv
        a, b = _seeds(codes[held], lv)
        for i in range(HASHES):
            bits[base[held] + _position(a, b, i)] = 1
    return np.packbits(bits, bitorder="little")


def filter_parts(counts: DataFrame, low: int = MIN_LEVEL) -> DataFrame:
    """(bucket, bits) of the filter of ``SENT`` rows."""
    def fill(group: pa.Table) -> pa.Table:
        codes, counts, _ = _summed(*_parts_of(group))
        return pa.table({"bucket": group.column("bucket")[:1], "bits": pa.array([filled(codes, counts, low).tobytes()], pa.binary())})

    return counts.groupBy("bucket").applyInArrow(fill, "bucket int, bits binary")


def assembled(parts: DataFrame, buckets: int, low: int = MIN_LEVEL) -> Filter:
    """The filter of all its parts, on the driver."""
    held = {r["bucket"]: np.frombuffer(r["bits"], np.uint8) for r in parts.select("bucket", "bits").toLocalIterator()}       # max_filter_bytes in all
    sizes = np.array([len(held.get(b, b"")) * 8 // SEGMENT_BITS for b in range(buckets)])
    return Filter(np.concatenate([np.zeros(0, np.uint8), *(held[b] for b in sorted(held))]), low, sizes)


def build_filter(counts: DataFrame, low: int = MIN_LEVEL) -> Filter:
    """The filter of (code, n) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_numpy().view(np.uint64)
            order = np.argsort(codes)
            yield _counted(codes[order], batch.column("n").to_numpy()[order], 1)

    return assembled(filter_parts(map_arrow(counts.select("code", "n"), run, SENT), low), 1, low)


# -- a filter that is too large to broadcast ------------------------------------------
def chunked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` plus ``_chunk``: about ``CHUNK_CHARS`` of texts, dealt by what the rows hold."""
    chars = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return rows.withColumn("_chunk", F.pmod(F.xxhash64(*keys, "_text", F.spark_partition_id()), F.lit(chars // CHUNK_CHARS + 1)))


def chunk_codes(h: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted codes of a chunk's words and distinct bigrams, the place there of each word, that of each token's bigram)."""
    pairs, at = np.unique(previous(numbers) * len(h) + numbers, return_inverse=True)
    codes = np.concatenate([unigram_codes(h), bigram_codes(h[pairs // len(h)], h[pairs % len(h)])])
    order = np.argsort(codes)
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes))
    return codes[order], place[:len(h)], place[len(h):][at]


def answered(chunks: DataFrame, counts: DataFrame | None, buckets: int, low: int = MIN_LEVEL) -> DataFrame:
    """(chunk, bucket, levels): the level of each code of the chunks, probed at its bucket of the filter.

    Learned from the chunks' ``_train`` rows and from ``counts``.
    """
    def send(group: pa.Table) -> pa.Table:
        words, numbers, ends = numbered(group.column("_text"))
        codes, of_words, of_pairs = chunk_codes(word_hashes(words), numbers)
        learned = np.repeat(group.column("_train").to_numpy(), np.diff(ends, prepend=0))
        n = np.bincount(of_words[numbers[learned]], minlength=len(codes)) + np.bincount(of_pairs[learned], minlength=len(codes))
        return pa.Table.from_batches([_counted(codes, n, buckets, group.column("_chunk")[0].as_py())])

    def answer(group: pa.Table) -> pa.Table:
        codes, n = _parts_of(group)
        distinct, total, place = _summed(codes, n)
        levels = Filter(filled(distinct, total, low), low).levels(distinct).astype(np.int8)[place]
        answers = [zlib.compress(x.tobytes(), 1) for x in np.split(levels, np.cumsum([len(x) for x in codes])[:-1])]
        asked = group.select(["chunk", "bucket"]).append_column("levels", pa.array(answers, pa.binary()))
        return asked.filter(pc.not_equal(asked.column("chunk"), NO_CHUNK))

    # the texts are dealt to their chunks once: ``score_texts`` groups the same columns, so Spark reuses the exchange
    sent = chunks.groupBy("_chunk").applyInArrow(send, SENT)
    return (sent if counts is None else sent.union(counts)).groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, levels binary")


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words above the lowest count that leaves at most ``most`` of them, with their counts."""
    grade = F.floor(8 * F.log2("c") + 1e-9).cast("int")
    held = sorted(((r["grade"], r["rows"]) for r in counts.groupBy(grade.alias("grade"))
                   .agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)  # 8 grades a doubling
    low, n = 1 << 30, 0
    for at, rows in held:
        if n + rows > most:
            break
        low, n = at, n + rows
    table = counts.filter(grade >= low).toArrow()                                   # ``most`` rows
    return dict(zip(table.column("token").to_pylist(), table.column("c").to_pylist(), strict=True))


def score_texts(docs: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text",
                keep: list[str] | None = None, head_words: int = HEAD_WORDS, prior: float = PRIOR,
                max_filter_bytes: int = MAX_FILTER_BYTES, min_count: int = MIN_COUNT, head_codes: int = 0) -> DataFrame:
    """Columns ``keep`` plus n_tokens, n_known, train_tokens, base_score and score per row of ``docs``.

    ``train`` is any DataFrame with ``text_col``, or a condition on the rows of
    ``docs`` (null: not learned from), which saves sending their codes twice.
    Words and bigrams seen less often than ``min_count`` (1 or 2) count as not
    seen in ``score``.  A filter that might exceed ``max_filter_bytes`` is not
    broadcast.  ``head_codes`` has no effect any more: no code is sent for its level alone.
    """
    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    own = isinstance(train, Column)
    learned = (docs.filter(train) if own else train).select(F.col(text_col).alias("text"))
    low = MIN_LEVEL if min_count > 1 else 0
    counts = staged(_word_counts(learned), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-2 * total // CODES_PER_BUCKET))
    # at most so many bytes of keys, and a started segment a bucket
    whole = (2 * total * KEYS_PER_COUNT * BITS_PER_KEY + buckets * SEGMENT_BITS) / 8 <= max_filter_bytes
    bloom = assembled(staged(filter_parts(_code_counts(learned, buckets), low), "lm-filter"), buckets, low) if whole else None
    head = frequent_words(counts, head_words)
    shared = spark.sparkContext.broadcast((head, bloom))                       # head_words and max_filter_bytes
    norm = float(total + distinct + 1)

    def score(columns: list, texts: pa.Array | pa.ChunkedArray, levels: Callable) -> pa.RecordBatch:
        head = shared.value[0]
        seen_words, seen_pairs = expected_counts(0.5, low), expected_counts(0.0, low)
        words, numbers, ends = numbered(texts)
        starts = np.concatenate([[0], ends[:-1]])
        h = word_hashes(words)
        before = previous(numbers)
        of_words, of_pairs = levels(h, numbers)
        c1 = seen_words[of_words]
        c2 = np.minimum(seen_pairs[of_pairs], c1[before])
        p1 = (c1 + 1) / norm
        p = (c2 + prior * p1[numbers]) / (c1[before] + prior)
        exact = np.array([head.get(w, -1) for w in words], np.float64)
        known = exact[numbers] >= 0
        base = np.where(known, np.log10((np.maximum(exact, 0) + 1) / norm)[numbers], 0.0)
        # words beyond the head, once a text with their number there
        rare = np.flatnonzero(~known)
        text_of = np.searchsorted(ends, rare, side="right")
        held, at, n = np.unique(text_of * len(words) + numbers[rare], return_index=True, return_counts=True)
        order = np.argsort(at)                          # in the text's order, whatever texts lie in the chunk
        held, n = held[order], n[order]
        offsets = np.searchsorted(held // len(words), np.arange(len(ends) + 1)).astype(np.int32)
        tokens = pa.array(words, pa.binary()).take(pa.array(held % max(1, len(words))))
        tails = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([tokens, pa.array(n, pa.int64())], ["token", "n"]))
        add = lambda x: np.add.reduceat(x, starts)
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(ends - starts),
             pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p))),
             tails],
            [*keep, "_row", "n_tokens", "n_known", "base_score", "score", "_tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value[1]

        def levels(h: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(previous(numbers) * len(h) + numbers, return_inverse=True)     # each bigram is probed once
            return bloom.levels(unigram_codes(h)), bloom.levels(bigram_codes(h[pairs // len(h)], h[pairs % len(h)]))[at]

        for batch in batches:
            for i, j in text_chunks(batch, "_text", 2_000_000):
                yield score([batch.column(k)[i:j] for k in range(len(keep) + 1)], batch.column("_text")[i:j], levels)

    def run_chunk(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = group.combine_chunks()

        def levels(h: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, of_words, of_pairs = chunk_codes(h, numbers)             # sorted, as the buckets are
            found = dict(zip(answers.column("bucket").to_pylist(), answers.column("levels").to_pylist(), strict=True))
            level = np.concatenate([np.frombuffer(zlib.decompress(found[b]), np.int8) for b in sorted(found)])
            return level[of_words], level[of_pairs]

        columns = [group.column(k).combine_chunks() for k in range(len(keep) + 1)]
        return pa.Table.from_batches([score(columns, group.column("_text"), levels)])

    schema = (docs.select(*keep).schema.add("_row", "long").add("n_tokens", "long").add("n_known", "long")
              .add("base_score", "double").add("score", "double"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _tail array<struct<token: binary, n: bigint>>"
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"),
                       (F.coalesce(train, F.lit(False)) if own else F.lit(False)).alias("_train"))
    if whole:
        scored = map_arrow(rows, run, ddl)
    else:
        chunks = chunked(rows, keep)
        answers = answered(chunks, None if own else _code_counts(learned, buckets), buckets, low)
        scored = chunks.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run_chunk, ddl)
    scored = staged(scored, "lm-scored")
    rare = scored.select("_row", F.inline("_tail")).join(counts, "token", "left")
    tail = rare.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / norm)).alias("_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_known"))
    return scored.join(tail, "_row", "left").select(
        *keep, "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score")

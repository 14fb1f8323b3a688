"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared A-Z lower-cased and without ASCII punctuation at their
ends.  The benchmark's n-grams are counted over all documents; of those that
occur at all, each item keeps its rarest as seeds, by rank within the item (so
an item whose passage is everywhere keeps seeds too) and so many that a copy
with as many changed or missing words as the threshold allows still holds
one (words put in cost half as much and break n-grams too: a copy with one
after every second word of the item holds no whole n-gram and is not found).
A document that holds a seed is aligned
locally with the item around the seed's diagonal.  An exact bound (words of
the window that occur in the item at all) skips windows that cannot reach the
threshold.  Items are taken in blocks of bounded size, one broadcast a block.

Defined cases: null or empty texts and items of fewer words than a seed match
nothing; repeated rows and items are scored each on their own; ties between
windows go to the earlier one; empty tables give no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from murmur.llm.common import fold_words, map_arrow, text_chunks

SEED_WORDS = 3
MIN_SIMILARITY = 0.6        # Smith-Waterman score per word of the item
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
BLOCK_WORDS = 500_000       # words of the items of one block
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_words(text: str | None) -> list[bytes]:
    return [s for w in fold_words(text) if (s := w.strip(PUNCTUATION))]


class Block:
    """A block of items as word numbers, and the sorted codes of its n-grams."""

    def __init__(self, items: list[tuple], seed_words: int):
        self.n, self.vocab, self.items = seed_words, {}, []
        for item_id, text in items:
            words = clean_words(text)
            if len(words) >= seed_words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                self.items.append((item_id, np.array(ids, np.int64)))
        pairs = [(g, k, at) for k, (_, ids) in enumerate(self.items) for at, g in enumerate(self.codes(ids).tolist())]
        self.grams = np.unique(np.array([p[0] for p in pairs], np.int64))
        self.pairs = pairs
        self.seeds: dict[int, list[tuple[int, int]]] = {}

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """One number for each n-gram, -1 where a word is not the block's (hash, checked by alignment)."""
        n = len(ids) - self.n + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.n):
            part = ids[k:k + n]
            with np.errstate(over="ignore"):
                out = out * np.int64(1_000_003) + part + 1
            known &= part >= 0
        return np.where(known, out & np.int64(0x7FFFFFFFFFFFFFFF), -1)

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        words = clean_words(text)
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the text, index into ``grams``) of every n-gram of the block."""
        codes = self.codes(ids)
        at = np.flatnonzero(codes >= 0)
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.grams, codes[at]), len(self.grams) - 1)
        hit = self.grams[place] == codes[at]
        return at[hit], place[hit]

    def choose_seeds(self, counts: dict[int, int], min_similarity: float) -> None:
        """The rarest n-grams that occur, all but the commonest that a copy within the threshold cannot do without.

        Each changed word costs a match and a penalty and breaks ``n`` n-grams
        at most; the copy holds all others, so leaving out one fewer than
        these many leaves at least one seed in it.
        """
        by_item: dict[int, list] = {}
        for g, k, at in self.pairs:
            if counts.get(g, 0):
                by_item.setdefault(k, []).append((counts[g], at, g))
        for k, grams in by_item.items():
            size = len(self.items[k][1])
            edits = int((1 - min_similarity) * MATCH * size / (MATCH - MISMATCH) + 1e-9)
            sure = size - self.n + 1 - self.n * edits
            for _, at, g in sorted(grams)[:max(1, len(grams) - max(0, sure - 1))]:
                self.seeds.setdefault(int(np.searchsorted(self.grams, g)), []).append((k, at))
        self.pairs = []
        self.is_seed = np.zeros(len(self.grams), bool)
        self.is_seed[list(self.seeds)] = True


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best Smith-Waterman score and where it ends: (score, item end, text end), ends exclusive."""
    cols = np.arange(1, len(text) + 1)
    row, best = np.zeros(len(text) + 1), (0.0, 0, 0)
    for i, w in enumerate(item):
        step = np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP)
        step = np.maximum(step, 0.0)
        # a run of gaps along the text is a running maximum of score minus its gap cost
        step = np.maximum(step, np.maximum.accumulate(step - GAP * cols) + GAP * cols)
        row = np.concatenate([[0.0], step])
        at = int(step.argmax())
        if step[at] > best[0]:
            best = float(step[at]), i + 1, at + 1
    return best


def matches(block: Block, text: str | None, min_similarity: float) -> list[tuple]:
    """(item id, similarity, first word, words) of each item found in the text."""
    ids = block.numbers(text)
    at, gram = block.found(ids)
    keep = block.is_seed[gram] if len(at) else at.astype(bool)
    spans: dict[int, list[tuple[int, int]]] = {}
    for p, g in zip(at[keep].tolist(), gram[keep].tolist(), strict=True):
        for k, q in block.seeds[g]:
            size = len(block.items[k][1])
            slack = size // 3 + 2
            lo, hi = max(0, p - q - slack), min(len(ids), p - q + size + slack)
            held = spans.setdefault(k, [])
            if held and lo <= held[-1][1] and hi - held[-1][0] <= 4 * (size + 2 * slack):
                held[-1] = (min(lo, held[-1][0]), max(hi, held[-1][1]))
            elif not held or (lo, hi) != held[-1]:
                held.append((lo, hi))
    out = []
    for k, windows in spans.items():
        item_id, item = block.items[k]
        best = None
        for lo, hi in windows:
            window = ids[lo:hi]
            if np.isin(window, item).sum() * MATCH < min_similarity * len(item):
                continue
            score, item_end, end = align(item, window)
            if score >= min_similarity * len(item) and (best is None or score > best[0]):
                _, _, back = align(item[:item_end][::-1], window[:end][::-1])
                best = score, lo + end - back, back
        if best:
            out.append((item_id, best[0] / len(item), best[1], best[2]))
    return out


def _gram_totals(texts: DataFrame, shared) -> dict[int, int]:
    """Occurrences of the block's n-grams over all documents (one row a gram of the block at most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        totals = np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for t in batch.column("text"):
                totals += np.bincount(block.found(block.numbers(t.as_py()))[1], minlength=len(totals))
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(block.grams[some]), pa.array(totals[some])], ["gram", "n"])

    counted = map_arrow(texts.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS,
                 min_similarity: float = MIN_SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item, similarity, first_word, n_words): one row per document row and item found in it."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    doc_type, item_type = texts.schema["doc"].dataType.simpleString(), items.schema["item"].dataType
    schema = f"doc {doc_type}, item {item_type.simpleString()}, similarity double, first_word long, n_words long"
    item_arrow = to_arrow_type(item_type)
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        # a block holds block_words words or so; every block is held against all documents
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        block = Block([(r["item"], r["text"]) for r in rows], seed_words)
        if not block.items:
            continue
        block.choose_seeds(_gram_totals(texts, spark.sparkContext.broadcast(block)), min_similarity)
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j in text_chunks(batch, "text"):
                    at, found = [], []
                    for r in range(i, j):
                        hits = matches(shared.value, batch.column("text")[r].as_py(), min_similarity)
                        at += [r] * len(hits)
                        found += hits
                    if found:
                        item, sim, first, n = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc").take(pa.array(at)), pa.array(item, item_arrow), pa.array(sim, pa.float64()),
                             pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                            ["doc", "item", "similarity", "first_word", "n_words"])

        out = out.union(map_arrow(texts, run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **rules) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, told apart by (id, text hash)."""
    mark = F.xxhash64(text_col)
    named = docs.select(F.struct(F.col(id_col).alias("id"), mark.alias("mark")).alias("doc"), F.col(text_col).alias("text"))
    bad = contaminated(named, benchmark, "doc", "text", **rules).select(
        F.col("doc.id").alias("_bad_id"), F.col("doc.mark").alias("_bad_mark")).distinct()
    rows = docs.withColumn("_mark", mark)
    same = rows[id_col].eqNullSafe(bad["_bad_id"]) & (rows["_mark"] == bad["_bad_mark"])
    return rows.join(bad, same, "left_anti").select(*docs.columns)

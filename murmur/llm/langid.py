"""Language identification by words first, character n-grams for the rest.

A known word scores by its log frequency in each language.  An unseen word
backs off to its character n-grams (word ends marked), longest first: the
mean of the known n-grams of the first length that has any.  The classifier
is fitted on a bounded sample of labelled rows (``ROWS_PER_LANG`` different
texts a language) and keeps every word and n-gram of it; prediction reads the
whole of every text.

The score is the share of the best language among all, times the share of the
text's words of which anything is known: a text in a script that was not
learned scores 0, however few the languages are.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows without a language are not learned from; with nothing learned everything
is ``und``; copies of a text are learned from once; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import map_arrow, text_chunks

ROWS_PER_LANG = 1_500
MAX_GRAM = 4
EVIDENCE_WORDS = 40         # a text's mean word score counts as that of at most so many words
GATHERED_GRAMS = 100_000    # n-grams of unseen words that are scored at once
BROADCAST_LANGS = 10_000     # above so many languages the sampling shares are joined by a shuffle
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, n, gram, count): words are n = 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_chunks(batch, "text"):
                words: dict[str, Counter] = {}
                for lang, text in zip(batch.column("lang")[i:j].to_pylist(), batch.column("text")[i:j].to_pylist(),
                                      strict=True):
                    words.setdefault(lang, Counter()).update(words_of(text or ""))
                for lang, counts in words.items():
                    rows = [(0, w, c) for w, c in counts.items()]
                    for n in range(1, MAX_GRAM + 1):
                        grams: Counter = Counter()
                        for w, c in counts.items():
                            for g in grams_of(w, n):
                                grams[g] += c
                        rows += [(n, g, c) for g, c in grams.items()]
                    if rows:
                        n, g, c = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(n, pa.int32()),
                                                          pa.array(g), pa.array(c, pa.int64())],
                                                         ["lang", "n", "gram", "count"])

    return (map_arrow(labelled, run, "lang string, n int, gram string, count long")
            .groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")))


class Model:
    """Log frequencies of words and n-grams: ``rows[n][gram]`` is a row of ``logs[n]``, one column a language."""

    def __init__(self, lang: list[str], n: list[int], gram: list[str], count: list[int]):
        self.langs = sorted(set(lang))
        at = {x: i for i, x in enumerate(self.langs)}
        self.rows: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
        place = [self.rows[k].setdefault(g, len(self.rows[k])) for k, g in zip(n, gram, strict=True)]
        counts = [np.zeros((len(r), len(at))) for r in self.rows]
        for k, i, x, c in zip(n, place, lang, count, strict=True):
            counts[k][i, at[x]] = c
        self.logs = [np.log10((c + 0.5) / (c.sum(axis=0) + 0.5 * max(1, len(c)))) for c in counts]

    def unseen(self, words: list[str], counts: list[float]) -> tuple[np.ndarray, float]:
        """Back-off scores of words that were not learned, summed, and the count of words without any known n-gram."""
        total, left = np.zeros(len(self.langs)), list(zip(words, counts, strict=True))
        for n in range(MAX_GRAM, 0, -1):
            get, logs, shorter = self.rows[n].get, self.logs[n], []
            at: list[int] = []
            weights: list[float] = []
            for w, c in left:
                known = [i for g in grams_of(w, n) if (i := get(g)) is not None]
                if not known:
                    shorter.append((w, c))
                    continue
                at += known
                weights += [c / len(known)] * len(known)
                if len(at) >= GATHERED_GRAMS:
                    total += np.array(weights) @ logs[at]
                    at, weights = [], []
            if at:
                total += np.array(weights) @ logs[at]
            left = shorter
        return total, sum(c for _, c in left)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text)) if text and self.langs else None
        if not counts:
            return UNKNOWN, 0.0
        weights = np.fromiter(counts.values(), np.float64, len(counts))
        get = self.rows[0].get
        row = np.fromiter((get(w, -1) for w in counts), np.int64, len(counts))
        known = row >= 0
        total, blank = weights[known] @ self.logs[0][row[known]], 0.0
        if not known.all():
            new = [(w, c) for (w, c), k in zip(counts.items(), known.tolist(), strict=True) if not k]
            backed_off, blank = self.unseen([w for w, _ in new], [c for _, c in new])
            total = total + backed_off
        mean = total / weights.sum()
        scaled = (mean - mean.max()) * min(weights.sum(), EVIDENCE_WORDS) * np.log(10)
        p = np.exp(scaled)
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum() * (1 - blank / weights.sum()))


def learning_sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                    rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """(text, lang) of at most ``rows_per_lang`` different texts a language: those with the smallest hashes.

    Texts are counted by their hashes; a share that leaves about twice as many
    is drawn before any text is shuffled, and copies meet map-side.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().withColumn(
        "_h", F.xxhash64("text"))
    totals = rows.select("lang", "_h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.withColumnRenamed("lang", "_lang")
    # hashes fall evenly into [-2^63, 2^63): the bound of the share, as a double
    bound = F.least(F.lit(1.0), 2 * rows_per_lang / F.col("_n")) * 2.0 ** 64 - 2.0 ** 63
    if totals.count() <= BROADCAST_LANGS:
        totals = F.broadcast(totals)                            # a row a language
    drawn = (rows.join(totals, F.col("lang") == F.col("_lang")).filter(F.col("_h").cast("double") <= bound)
             .groupBy("lang", "_h").agg(F.min("text").alias("text")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    return drawn.withColumn("_place", place).filter(F.col("_place") <= rows_per_lang).select("text", "lang")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """The classifier of the non-null (text, lang) rows, from their ``learning_sample``."""
    counts = _gram_counts(learning_sample(labelled, text_col, lang_col, rows_per_lang))
    table = counts.toArrow()                                    # words and n-grams of ROWS_PER_LANG texts a language
    return Model(*(table.column(i).to_pylist() for i in range(4)))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus ``lang_pred`` and ``lang_score`` per row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("lang_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_chunks(batch, "_text"):
                found = [shared.value.predict(t.as_py()) for t in batch.column("_text")[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[i:j] for k in range(len(keep))), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "lang_score"])

    return map_arrow(docs.select(*keep, F.col(text_col).alias("_text")), run, schema)

"""Line dedup: drop lines that many documents share, keep one document's copy.

DataFrame functions only.  Every candidate line becomes one small row (two
64-bit hashes of its key, document, position); the rows are range-partitioned
by hash and document, so a hash held by a third of all documents spreads over
many ranges, and sorted by hash, document and position within.  A task streams
its sorted rows and marks the first row of each hash and document; the marks
are counted per hash (partially in the task), which gives the number of
documents and the largest, the one that keeps the line.  The result per
document is a sparse drop bitmap (64-line words with their masks, all-keep
words left out), never text.

Defined cases: a null or empty text is one empty line; a row without id
counts as a document with the smallest id; repeated rows are one document if
they share the id; an empty table gives no rows.  Other columns of the input
are ignored by ``line_bitmaps`` and kept by ``drop_repeated_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import WHITE, ascii_lower, staged


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_id(text: Column) -> Column:
    """Tells apart rows that share an id; equal texts have equal bitmaps."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(doc, t, h1, h2, pos) per line whose key has at least ``min_chars`` code points."""
    lines = docs.select(F.col(id_col).alias("doc"), _text_id(F.col(text_col)).alias("t"),
                        F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    keyed = (lines.select("doc", "t", "pos", F.btrim("line", F.lit(WHITE)).alias("line"))
             .filter(F.char_length("line") >= min_chars)
             .select("doc", "t", "pos", ascii_lower(F.col("line")).alias("key")))
    return keyed.select("doc", "t", "pos", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                 min_docs: int = 5) -> DataFrame:
    """(doc, t, drops) for documents that lose lines.

    ``drops`` maps the number of a 64-line word to the mask of its dropped
    lines; lines of words that are not in the map stay.
    """
    rows = staged(line_rows(docs, id_col, text_col, min_chars), "line-rows")
    # the window's sort runs inside the ranges: they hold a hash's rows of one document together, no exchange
    in_doc = Window.partitionBy("h1", "h2", "doc").orderBy("pos", "t")
    marked = (rows.select("h1", "h2", "doc", "pos", "t").repartitionByRange("h1", "h2", "doc")
              .withColumn("first", F.lag(F.lit(1)).over(in_doc).isNull()))
    repeated = (marked.filter("first").groupBy("h1", "h2")
                .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("first_doc"))
                .filter(F.col("n_docs") >= min_docs).drop("n_docs"))
    dropped = rows.join(repeated, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("first_doc")))
    words = (dropped.groupBy("doc", "t", F.shiftright("pos", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("mask")))
    return words.groupBy("doc", "t").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("drops"))


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """All columns of ``docs`` plus ``_drops`` (null: every line stays)."""
    maps = line_bitmaps(docs, id_col, text_col, **rules)
    keyed = docs.withColumn("_t", _text_id(F.col(text_col)))
    joined = keyed.join(maps, keyed[id_col].eqNullSafe(maps["doc"]) & (F.col("_t") == F.col("t")), "left")
    return joined.select(*[keyed[c] for c in docs.columns], F.col("drops").alias("_drops"))


def _kept(text: Column, drops: Column) -> Column:
    stays = F.filter(_lines(text), lambda _line, i: F.coalesce(
        F.getbit(F.element_at(drops, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(0)) == 0)
    return F.when(drops.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stays, "\n"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text_col``; other columns as they were.

    A document that loses nothing keeps its text as it is (null stays null).
    """
    marked = with_bitmaps(docs, id_col, text_col, **rules)
    new = F.when(F.col("_drops").isNull(), F.col(text_col)).otherwise(_kept(F.col(text_col), F.col("_drops")))
    return marked.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """Per document: id, n_lines, n_dropped and SHA-256 of the kept text (the bitmaps: ``line_bitmaps``)."""
    marked = with_bitmaps(docs.select(id_col, text_col), id_col, text_col, **rules)
    n_dropped = F.aggregate(F.map_values("_drops"), F.lit(0), lambda a, m: a + F.bit_count(m))
    return marked.select(
        F.col(id_col),
        F.size(_lines(F.col(text_col))).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(_kept(F.col(text_col), F.col("_drops")).cast("binary"), 256).alias("kept_sha256"))

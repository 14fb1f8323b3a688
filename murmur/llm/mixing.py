"""Mix sources to target weights by exact token budgets.

Every document gets a hash-random key; documents are range-sorted by key
within their source, distributed prefix sums of their sizes place each of
them on the source's number line, and the line is cut at the source's exact
budget.  Budgets beyond the source's size repeat whole epochs and cut the
last one.  The document at the cut gives only its first words, so a source's
taken words equal its rounded target.

Defined cases: a null text has size 0 and is never taken; null is a source of
its own, ordered last; documents without id share one key and are ordered by
size; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import WORD_PATTERN, prefix_sums

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Targets are ``least(max_epochs * source_size, level * weight)``: the level
    at which they add up to ``share`` of all sizes is what resharing the
    excess by weight ends in.  Sources ordered by cap / weight fill up one
    after the other, so prefix sums over that order find the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns(
        {"_all": F.lit(0), "one": F.lit(1)})
    ranked = prefix_sums(totals, ["_all"], [F.col("source").isNull(), F.col("source")], ["one"], "mix-sources")
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    capped = ranked.select("_all", "source", "source_size", pick.alias("weight")).withColumn(
        "cap", F.col("source_size") * max_epochs)
    filled = prefix_sums(capped, ["_all"], [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")],
                         ["cap", "weight"], "mix-levels")
    whole = capped.agg((F.sum("source_size") * F.lit(float(share))).alias("budget"), F.sum("weight").alias("weights"))
    level = (F.col("budget") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    levels = filled.crossJoin(F.broadcast(whole)).withColumn("level", level)        # ``whole`` is one row
    open_ = levels.filter(F.col("cap") > F.col("weight") * F.col("level")).agg(
        F.min_by("level", F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")))
        .alias("final"))
    return levels.crossJoin(F.broadcast(open_)).select(                             # ``open_`` is one row
        "source", "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("final")),
                   F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = "mix",
        keep: dict | None = None) -> DataFrame:
    """(doc, source, size, source_size, target, taken) per document; taken counts repeats.

    ``keep`` names further small columns (name -> Column of ``docs``) to carry along.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    sized = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), size.alias("size"),
                        key.alias("_key"), *[c.alias(n) for n, c in (keep or {}).items()])
    placed = prefix_sums(sized, ["source"], [F.col("_key"), F.col("doc"), F.col("size")], ["size"], "mix-docs")
    targets = source_targets(sized.select("source", "size"), weights, share, max_epochs).withColumnRenamed(
        "source", "_source")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("size_before")))
    return joined.select("doc", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
                         *(keep or {}))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **rules) -> DataFrame:
    """The mix itself: one row per document and epoch taken, with all columns
    of ``docs``, the epoch and the words taken; the document at a source's cut
    keeps its first words only."""
    t = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    plan = mix(docs, id_col, text_col, source_col, keep={"_mt": t}, **rules).filter(F.col("taken") > 0)
    same = lambda *cols: F.row_number().over(Window.partitionBy(*cols).orderBy(F.lit(0)))
    # rows alike in id, source and text are interchangeable; numbering them pairs each with its own share
    plan = plan.select(F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.col("doc").alias("_doc"),
                       F.col("source").alias("_src"), "_mt", same("doc", "source", "_mt").alias("_mn"))
    full = docs.withColumn("_t", t).withColumn("_n", same(id_col, source_col, "_t"))
    rows = full.join(plan, full[id_col].eqNullSafe(plan["_doc"]) & full[source_col].eqNullSafe(plan["_src"])
                     & (F.col("_t") == F.col("_mt")) & (F.col("_n") == F.col("_mn")))
    each = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("_size")) - 1)))
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_epoch") * F.col("_size"))
    lead = F.regexp_extract(F.col(text_col), r"^[\x20\x09-\x0D]*", 0)
    first = F.array_join(F.slice(F.split(F.substr(F.col(text_col), F.char_length(lead) + 1), r"[\x20\x09-\x0D]+"),
                                 F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("_size"), first).otherwise(F.col(text_col))
    return each.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
                       F.col("_epoch").cast("long").alias("mix_epoch"), words.cast("long").alias("mix_words"))

"""Filter interaction audit: what each filter removes in every order of application.

One scan gives each document a mask of the filters it fails; documents are
counted by (part, mask), at most 32 cells a part.  Each cell folds across the
array of all filter orders (a constant of the plan, sent with it to every
task): ``transform`` over the orders, ``aggregate`` over an order's filters,
which gives one struct a step, weighted by the cell's counts.  The structs of
a part's cells are merged by elementwise sums.

Filters (a document fails if): A under ``MIN_WORDS`` words; B fewer distinct
words than ``MIN_DISTINCT`` percent; C more capitals A-Z than ``MAX_CAPITALS``
percent of the code points; D holds one of ``# $ % & * |``; E its text is that
of a document with a smaller id, removed or not.

Defined cases: a null text is empty; an empty text fails A only, and E if
repeated; a null part is the empty string; a row without id never fails E and
makes no other fail it, and has no labels; repeated rows each count, and do
not make each other fail E; a document labelled more than once is good (toxic)
if any of its rows says so; an empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import WORD_PATTERN, staged

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
MARKS = r"[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _text_fails(text: Column) -> list[Column]:
    """Failure conditions A to D of a text."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < MIN_WORDS, F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT,
            capitals * 100 > F.char_length(text) * MAX_CAPITALS, text.rlike(MARKS)]


def document_fails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) per row; bit i of ``mask`` is set if the i-th filter fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(_text_fails(F.col("text")))]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    rows = staged(rows.select("id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("key"), mask.alias("mask")),
                  "audit-rows")
    firsts = (rows.filter("id is not null").groupBy("key").agg(F.min("id").alias("first"))
              .select(F.col("key").alias("first_key"), "first"))
    # joined by text and id, so that the copies of one text are dealt over all tasks
    copies = rows.join(firsts, (F.col("key") == F.col("first_key")) & (F.col("id") == F.col("first")), "left")
    later = F.col("id").isNotNull() & F.col("first").isNull()
    return copies.select("id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def mask_cells(fails: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each cell and those labelled good or toxic."""
    marks = labels.groupBy(F.col(label_id).alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return fails.join(marks, F.col("id") == F.col("label_id"), "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def fold_orders(cells: DataFrame) -> DataFrame:
    """``cells`` plus ``steps``: a struct of COUNTS for each step of each order (120 x 5)."""
    orders = F.array(*[F.array(*[F.lit(FILTERS.index(f)) for f in o]) for o in ORDERS])
    mask, n, good, toxic = (F.col(c) for c in ("mask", "n", "good", "toxic"))
    zero = F.lit(0).cast("long")

    def apply_filter(state: Column, f: Column) -> Column:
        bit = F.shiftleft(F.lit(1), f) if isinstance(f, int) else F.call_function("shiftleft", F.lit(1), f)
        fails = mask.bitwiseAND(bit) != 0
        alive = state["alive"]
        here = alive & fails
        step = F.struct(F.when(alive & ~fails, n).otherwise(zero).alias("kept"),
                        F.when(here, n).otherwise(zero).alias("removed"),
                        F.when(fails & ~alive, n).otherwise(zero).alias("redundant"),
                        F.when(mask == bit, n).otherwise(zero).alias("unique_fails"),
                        F.when(here, good).otherwise(zero).alias("good_lost"),
                        F.when(here, toxic).otherwise(zero).alias("toxic_lost"))
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(step)).alias("steps"))

    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))
    folded = F.transform(orders, lambda order: F.aggregate(order, start, apply_filter, lambda s: s["steps"]))
    return cells.withColumn("steps", F.flatten(folded))


def merge_steps(folded: DataFrame) -> DataFrame:
    """(part, steps): the elementwise sums of the cells' steps, at most 32 cells a part."""
    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))

    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(FILTERS))
    return folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select(
        "part", F.aggregate("cells", zeros, add).alias("steps"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley) for every part, order and step."""
    cells = mask_cells(document_fails(docs, id_col, text_col, part_col), labels)
    merged = merge_steps(fold_orders(cells))
    at = F.col("at")
    names = F.array(*[F.lit(o) for o in ORDERS])
    rows = merged.select("part", "steps", F.posexplode("steps").alias("at", "s")).select(
        "part", "steps", "s", F.element_at(names, (F.floor(at / 5) + 1).cast("int")).alias("filter_order"),
        (F.pmod(at, F.lit(5)) + 1).cast("int").alias("step"))
    # the filter's removals at the same step of any order, whatever the step
    letters = F.array(*[F.lit(c) for o in ORDERS for c in o])
    mine = F.expr("substring(filter_order, step, 1)")
    shapley = F.aggregate(F.arrays_zip(F.col("steps.removed").alias("removed"), letters.alias("letter")), F.lit(0).cast("long"),
                          lambda t, x: t + F.when(x["letter"] == mine, x["removed"]).otherwise(F.lit(0).cast("long")))
    return rows.select("part", "filter_order", "step", *[F.col(f"s.{c}").alias(c) for c in COUNTS], shapley.alias("shapley"))

"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark
decontamination and mixing, over the whole ``documents`` table.

Each stage reads what its predecessor kept, from Parquet, and applies its
operator's decisions.  All stages but the last return the columns of
``documents``; the mix returns a row per document and epoch taken, with
``mix_epoch`` and ``mix_words`` besides them.  SQL cannot express the stages
(``ORACLE_SQL`` is None); they are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import decontaminate, langid, line_dedup, mixing, simhash
from murmur.llm.common import read_table, staged

MIN_LANG_SCORE = 0.3
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a clear language, go."""
    found = langid.identify(docs, langid.fit(docs))
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_LANG_SCORE)
    return found.filter(sure).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; ``n_chars`` follows the text."""
    left = line_dedup.drop_repeated_lines(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one_per_group(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights."""
    return mixing.mixed_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash", simhash_stage),
          ("decontaminate", decontaminate_stage), ("mix", mix_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs

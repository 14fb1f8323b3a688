"""Helpers shared by the corpus operators: table access, staging, ASCII
folding, hashing inside Arrow tasks and distributed prefix sums."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.session import scratch_table_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"
BATCH_ROWS, MAX_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
END = b""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage at a replicated table: a lost executor recomputes from
    the files, and every consumer sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_table_path(spark, f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the executors first (once a
    Spark context), so that tasks can import it wherever they run."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if int(spark.conf.get(BATCH_ROWS)) > MAX_BATCH_ROWS:    # whole texts: 10,000 of them are too many for one batch
        spark.conf.set(BATCH_ROWS, str(MAX_BATCH_ROWS))
    if not getattr(sc, "_murmur_sent", False):
        root = Path(__file__).resolve().parents[2]
        if root.is_dir():
            zipped = shutil.make_archive(f"{tempfile.mkdtemp()}/murmur", "zip", root, "murmur")
            sc.addPyFile(zipped)
        sc._murmur_sent = True
    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other code point unchanged.

    ``lower`` equals this for pure ASCII strings and is much cheaper than
    ``translate``, so only strings with other characters take the slow path.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def fold_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the A-Z lower-cased text as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def numbered(texts: pa.Array | pa.ChunkedArray | list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, numbers, ends): the texts' tokens as numbers into ``words``, end token (number 0) after each text."""
    held = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(held, "")))
    words = parts.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0            # none before a leading space
    of = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))[real]
    coded = words.filter(pa.array(real)).dictionary_encode()
    ends = np.cumsum(np.bincount(of, minlength=len(parts)) + 1).astype(np.int64)
    numbers = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    numbers[np.arange(len(of)) + of] = coded.indices.to_numpy().astype(np.int64) + 1
    return [END, *coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()], numbers, ends


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit mixer (xor-shift / multiply rounds) on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> pa.Array:
    """uint64 values as the int64 array with the same bits."""
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def text_chunks(batch: pa.RecordBatch, column: str, max_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of a batch whose texts hold about ``max_chars`` together.

    One very long text makes a range of its own, so the memory of a task is
    bounded by the longest text plus the limit.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > max_chars:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], values: list[str], name: str) -> DataFrame:
    """``df`` plus ``<value>_before``: the sum over the group's earlier rows.

    Rows are range-partitioned on (group, order), so a group of any size is
    spread over many tasks; each task sums its own slice, and the slice
    offsets come from a running sum over one row per (group, slice).  Rows
    that tie on ``order`` stay in one slice, in any order.  The columns
    ``_slice`` and ``_o<i>`` are used internally and dropped.
    """
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [f"_o{i}" for i in range(len(order))]
    sliced = staged(keyed.repartitionByRange(*[F.col(c) for c in (*group, *keys)])
                    .withColumn("_slice", F.spark_partition_id()), name)
    ahead = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*group, "_slice").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
               .select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_slice").alias("_g_slice"),
                       *[F.coalesce(F.sum(f"_t_{v}").over(ahead), F.lit(0)).alias(f"_off_{v}") for v in values]))
    match = F.col("_slice") == F.col("_g_slice")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(offsets, match).select(
        *df.columns, *[(F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before")
                       for v in values])

"""Sinks: per-date replacement of result tables, keyed upsert of complaints,
range deletes and exports.

Tables are Parquet folders partitioned by their date column (and
``dimension`` for result tables), so replacing a date touches only that
date's partitions and a range delete is a partition drop, never a rewrite.
Parquet has no MERGE: the upsert rewrites only the partitions that hold a
changed or new key, staging the merged rows under the shared checkpoint
folder first (a path cannot be read and overwritten by the same job).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import scratch_table_path


# -- file-system helpers (Hadoop FS API: any cluster file system) -------------
def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _partition_dir(table: str, spec: dict) -> str:
    return table.rstrip("/") + "/" + "/".join(f"{k}={v}" for k, v in spec.items())


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Dynamic partition overwrite: only partitions present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).parquet(path))


SWAP_FILE = "_swap"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _move(fs, path, source, target) -> None:
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"could not move {source} to {target}")


def swap_staged(spark: SparkSession, staged: str, table: str) -> None:
    """Put the partitions staged by ``stage_partitions`` in place of the table's.

    The list of moves was written with the data.  An old partition is moved
    aside before its successor takes the place, and deleted last with the
    staging folder, so an interrupted swap is finished by calling this again,
    and nothing is lost in between.
    """
    fs, root = _fs(spark, staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if path_exists(spark, f"{staged}/{SWAP_FILE}"):
        for line in read_text(spark, f"{staged}/{SWAP_FILE}").splitlines():
            kind, spec = line.split(" ", 1)
            old, new = path(f"{table.rstrip('/')}/{spec}"), path(f"{staged}/{spec}")
            if kind == "drop" or fs.exists(new):
                if fs.exists(old):
                    _move(fs, path, old, path(f"{staged}/_old/{spec}"))
                if kind == "put":
                    _move(fs, path, new, old)
    fs.delete(root, True)


def _partition_specs(spark: SparkSession, path: str, depth: int) -> set[str]:
    """Relative names of the partition folders ``depth`` levels below ``path``."""
    fs, root = _fs(spark, path)
    level = {""} if fs.exists(root) else set()
    for _ in range(depth):
        level = {f"{base}/{st.getPath().getName()}".lstrip("/") for base in level
                 for st in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{base}" if base else path))
                 if st.isDirectory() and "=" in st.getPath().getName()}
    return level


def stage_partitions(spark: SparkSession, df: DataFrame, table: str, parts: list[str], replaced=()) -> str:
    """Write ``df`` next to the table (same file system, so renames are moves) for ``swap_staged``.

    Partitions ``replaced`` (``a=1/b=2``) that ``df`` has no rows for are to go.
    Returns the staging folder.
    """
    staged = f"{table.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(staged)
    put = _partition_specs(spark, staged, len(parts))
    moves = [f"put {spec}" for spec in sorted(put)] + [f"drop {spec}" for spec in sorted(set(replaced) - put)]
    write_text(spark, f"{staged}/{SWAP_FILE}", "\n".join(moves))
    return staged


def replace_by_date(spark: SparkSession, df: DataFrame, table: str, date_col: str, dates: list,
                    dimensions: list[str] | None = None) -> None:
    """Replace the rows of ``dates`` (x ``dimensions``) in a result table with ``df``.

    Partitions of requested (date, dimension) pairs without rows in ``df`` are
    dropped, so a rerun that finds nothing also clears the old rows; pairs not
    requested are left alone.  ``df`` is computed once, into a folder beside
    the table, and its partitions are moved in.
    """
    by_dimension = "dimension" in df.columns
    parts = [date_col, "dimension"] if by_dimension else [date_col]
    df = df.filter(F.col(date_col).isin(*[F.lit(str(d)).cast("date") for d in dates]))
    if dimensions is not None and by_dimension:
        df = df.filter(F.col("dimension").isin(*dimensions))
    wanted, specs = {f"{date_col}={d}" for d in dates}, set()
    for spec in _partition_specs(spark, table, len(parts)):
        head, _, tail = spec.partition("/")
        if head in wanted and (not by_dimension or dimensions is None or tail.removeprefix("dimension=") in dimensions):
            specs.add(spec)
    swap_staged(spark, stage_partitions(spark, df, table, parts, specs), table)


def dedupe_batch(batch: DataFrame, key: str = "sr_number", order_cols: list[str] | None = None) -> DataFrame:
    """Keep the last row per key: the largest by ``order_cols``.

    Default order: ``_file`` and ``_position`` (name of the file, place in the
    file) if the batch has them, else read order.  One aggregation that keeps
    one row a key and task before the shuffle; the order columns are dropped.
    """
    order = order_cols or [c for c in ("_file", "_position") if c in batch.columns]
    if not order:
        batch, order = batch.withColumn("_position", F.monotonically_increasing_id()), ["_position"]
    cols = [c for c in batch.columns if c not in ("_file", "_position") and c != key]
    return (batch.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
            .select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in batch.columns
                      if c not in ("_file", "_position")]))


def merge_complaints(existing: DataFrame, batch: DataFrame, supplied: list[str],
                     key: str = "sr_number") -> DataFrame:
    """Rows after an upsert: batch values win for supplied columns (a supplied
    null overwrites); other columns keep the existing value; new keys are
    inserted.  Returns every resulting row of every touched key plus a flag."""
    b = batch.select(*[F.col(c).alias(f"_b_{c}") for c in batch.columns], F.lit(True).alias("_in_b"))
    e = existing.select(*[F.col(c).alias(f"_e_{c}") for c in existing.columns], F.lit(True).alias("_in_e"))
    j = e.join(b, F.col(f"_e_{key}") == F.col(f"_b_{key}"), "full_outer")
    cols = []
    for c in existing.columns:
        if c == key:
            v = F.coalesce(F.col(f"_b_{key}"), F.col(f"_e_{key}"))
        elif c in supplied:
            v = F.when(F.col("_in_b"), F.col(f"_b_{c}")).otherwise(F.col(f"_e_{c}"))
        elif c in batch.columns:
            # not supplied: keep the stored value; a new key takes the batch row (nulls)
            v = F.when(F.col("_in_e"), F.col(f"_e_{c}")).otherwise(F.col(f"_b_{c}"))
        else:
            v = F.col(f"_e_{c}")
        cols.append(v.alias(c))
    return j.select(*cols, F.coalesce(F.col("_in_b"), F.lit(False)).alias("_touched"),
                    F.col("_e_sr_open_dt").alias("_old_dt"))


WEIGHT = "_weight"


def prepare_upsert(spark: SparkSession, table: str, batch: DataFrame, supplied: list[str], key: str = "sr_number",
                   date_col: str = "sr_open_dt", images: str | None = None) -> tuple[str, dict]:
    """Stage an upsert of ``batch`` (already coerced); ``swap_staged`` makes it visible.

    The deduplicated batch is written once.  The stored dates of its keys come
    from a semi-join over the table's key and date columns alone; only the
    partitions of those and of the batch's own dates are read and merged.
    Changed rows are written to ``images`` if it is given, weighted -1 as they
    were and +1 as they are; rows that stay as they are leave no image.
    Returns the staging folder and the counts of inserted and updated keys.
    """
    stage = scratch_table_path(spark, f"upsert-{uuid.uuid4().hex}")
    dedupe_batch(batch, key).write.parquet(stage)
    batch = spark.read.schema(spark.read.parquet(stage).schema).parquet(stage)
    if not path_exists(spark, table):
        staged = stage_partitions(spark, batch, table, [date_col])
        changed, report = batch.withColumn(WEIGHT, F.lit(1)), {"inserted": batch.count(), "updated": 0}
    else:
        existing = spark.read.parquet(table)
        cols = existing.columns
        batch = batch.select(*cols)
        held = existing.select(key, date_col).join(batch.select(key), key, "left_semi").groupBy(date_col).agg(
            F.count(F.lit(1)).alias("n")).collect()             # a row a date
        new = batch.groupBy(date_col).agg(F.count(F.lit(1)).alias("n")).collect()
        dates = {r[date_col] for r in (*held, *new) if r[date_col] is not None}
        touched = existing.filter(F.col(date_col).isin(*dates))
        merged = merge_complaints(touched, batch, supplied, key)
        staged = stage_partitions(spark, merged.select(*cols), table, [date_col], {f"{date_col}={d}" for d in dates})
        after = merged.filter("_touched").select(*cols, F.lit(1).alias(WEIGHT))
        before = touched.join(batch.select(key), key, "left_semi").select(*cols, F.lit(-1).alias(WEIGHT))
        changed = (after.unionByName(before).groupBy(*cols).agg(F.sum(WEIGHT).cast("int").alias(WEIGHT))
                   .filter(F.col(WEIGHT) != 0))
        updated = sum(r["n"] for r in held)
        report = {"inserted": sum(r["n"] for r in new) - updated, "updated": updated}
    if images:
        changed.write.parquet(images)
    delete_path(spark, stage)
    return staged, report


def upsert_complaints(spark: SparkSession, table: str, batch: DataFrame, supplied: list[str],
                      key: str = "sr_number", date_col: str = "sr_open_dt") -> dict:
    """Insert or update ``batch`` (already coerced) into the partitioned table at ``table``.

    Returns counts of inserted and updated keys (see ``prepare_upsert``).
    """
    staged, report = prepare_upsert(spark, table, batch, supplied, key, date_col)
    swap_staged(spark, staged, table)
    return report


def delete_date_range(spark: SparkSession, tables: dict[str, str], start, end) -> DataFrame:
    """Drop the date partitions in [start, end] of each table; (table, removed) counts.

    ``tables`` maps a table name to (path); the date column is the table's
    first partition column.  Counting is partition-pruned.
    """
    rows = []
    for name, path in tables.items():
        if not path_exists(spark, path):
            rows.append((name, 0))
            continue
        fs, p = _fs(spark, path)
        parts = [st.getPath() for st in fs.listStatus(p) if "=" in st.getPath().getName()]
        if not parts:
            rows.append((name, 0))
            continue
        date_col = parts[0].getName().split("=", 1)[0]
        df = spark.read.parquet(path)
        removed = df.filter(F.col(date_col).between(F.lit(str(start)).cast("date"),
                                                    F.lit(str(end)).cast("date"))).count()
        for part in parts:
            v = part.getName().split("=", 1)[1]
            if str(start) <= v <= str(end):
                fs.delete(part, True)
        rows.append((name, removed))
    return spark.createDataFrame(rows, "table string, removed bigint")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; array columns joined with ', '."""
    cols = [F.array_join(F.col(f.name), ", ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_baselines(baselines: DataFrame, path: str) -> None:
    """Persist baselines partitioned by (dimension, as_of); other dates and dimensions are kept."""
    write_partitioned(baselines, path, ["dimension", "as_of"])


def read_baselines(spark: SparkSession, path: str, dimensions: list[str] | None = None,
                   as_of=None) -> DataFrame | None:
    """Stored baselines (partition-pruned); ``None`` when nothing is stored.

    A dimension without stored baselines simply has no rows (it is skipped,
    not an error); anomalies then see avg = std = 0 for it.
    """
    if not path_exists(spark, path):
        return None
    df = spark.read.parquet(path)
    if dimensions is not None:
        df = df.filter(F.col("dimension").isin(*dimensions))
    if as_of is not None:
        df = df.filter(F.col("as_of") == F.lit(str(as_of)).cast("date"))
    return df

"""Structured Streaming: a drop folder of complaint CSV files ingested as they arrive.

The stream carries the names of new files; each micro-batch reads its files
like a batch ingest does (encoding, separator and header of every file, quoted
newlines, row order by file and place), coerces them and upserts them.
Rejected rows go to the rejects folder, a partition (``batch``) a micro-batch,
named by the files it holds.  The checkpoint location makes the stream
restartable; a repeated batch upserts the same rows and replaces its own
rejects.  ``available_now`` processes what is there and stops.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from murmur.operators.ingest import SchemaError, coerce_complaints
from murmur.sources.csv import FILE_COLUMN, POSITION_COLUMN, read_complaints_csv
from murmur.sources.sinks import upsert_complaints

FILE_SCHEMA = "path string, modificationTime timestamp_ltz, length long, content binary"


def ingest_stream(spark: SparkSession, in_dir: str, table: str, checkpoint: str, columns: list[str] | None = None,
                  sep: str | None = None, encoding: str | None = None, available_now: bool = True,
                  rejects_path: str | None = None, max_files: int = 1000):
    """Start the ingest stream; returns the StreamingQuery.

    ``columns`` are names that the files of a micro-batch must have between
    them; ``max_files`` bounds a micro-batch.
    """
    # the path column alone: the files' contents are not read here
    names = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files)
             .load(in_dir).select("path"))

    def upsert_batch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        files = [r["path"] for r in batch.collect()]            # max_files at most
        if not files:
            return
        raw = read_complaints_csv(session, files, encoding, sep, with_position=True)
        if lacking := [c for c in columns or [] if c not in raw.columns]:
            raise SchemaError(lacking, raw.columns, columns)
        complaints, rejects, supplied = coerce_complaints(raw, keep=[FILE_COLUMN, POSITION_COLUMN])
        upsert_complaints(session, table, complaints, supplied)
        if rejects_path:
            name = hashlib.sha1("\n".join([str(epoch_id), *sorted(files)]).encode()).hexdigest()
            rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={name}")

    writer = names.writeStream.foreachBatch(upsert_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()

"""One large CSV file read by many tasks, in spite of quoted newlines.

Spark's text source deals a file's lines over byte ranges (blocks).  A line
either starts inside quotes or outside of them, so a line, and a block of
lines, is a map of these two states to two states:

1. every block hands out its map, one small row;
2. the maps of a file, composed in block order, give each block's first state;
3. every block puts its lines together to records from there.  Lines before
   its first record end a record of an earlier block, its last record may go
   on in the next one: these pieces, two a block at most, are joined.

The only thing broadcast is the table of first states: a row a block.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# the functions below travel with the job: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CLOSE = re.compile(rb'(?:[^"]|"")*+"')
_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("position", pa.int64()), ("record", pa.binary()),
                    ("whole", pa.bool_()), ("starts", pa.bool_()), ("header", pa.bool_())])
_MAP = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())])
BATCH_ROWS = 20_000


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether quotes are open after ``line``, given whether they are before it.

    A field is quoted if a quote is its first character; two quotes within it
    are one; text between the closing quote and the separator belongs to it.
    """
    if b'"' not in line:
        return inside
    pos = 0
    if not inside and line[:1] == b'"':
        pos, inside = 1, True
    while True:
        if inside:
            close = _CLOSE.match(line, pos)
            if not close:
                return True
            pos = close.end()
        start = line.find(sep + b'"', pos)
        if start < 0:
            return False
        pos, inside = start + len(sep) + 1, True


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, bytes | None]]:
    """(block, line without a byte-order mark, first state if there is one) in the order read."""
    previous = None
    for b in batches:
        if not b.num_rows:
            continue
        place = [b.column(c) for c in ("file", "block", "inside") if c in b.schema.names]
        ends = [tuple(c[i].as_py() for c in place) for i in (0, b.num_rows - 1)]
        # a block's lines stand together, so equal ends mean one block
        places = repeat(ends[0]) if ends[0] == ends[1] else zip(*(c.to_pylist() for c in place))
        for (file, block, *first), line in zip(places, b.column("line").to_pylist()):
            inside = first[0] if first else None
            key = (file, block)
            if key != previous and block == 0:
                line = line.removeprefix(b"\xef\xbb\xbf")
            previous = key
            yield key, line, inside


def _block_maps(sep: bytes):
    def run(batches):
        maps: dict[tuple, list[bool]] = {}          # a task's blocks
        for key, line, _ in _lines(batches):
            states = maps.setdefault(key, [False, True])
            if b'"' in line:
                states[:] = [ends_inside(line, s, sep) for s in states]
        rows = [{"file": k[0], "block": k[1], "from_out": s[0], "from_in": s[1]} for k, s in maps.items()]
        yield pa.RecordBatch.from_pylist(rows, _MAP)
    return run


def _block_records(sep: bytes, crlf: bool):
    """Records and pieces of each block; ``whole`` ones need no other block.  Empty lines between records go."""
    end = b"\r" if crlf else b""

    def run(batches):
        out: list[tuple] = []
        key, lines, inside, starts, at, begun, seen = None, [], False, True, 0, 0, False

        def close(whole: bool):
            nonlocal seen
            text = b"\n".join(lines)
            if whole and starts and not text:
                return
            place = 2 * (key[1] + begun) + (begun == 0 and key[1] > 0)
            out.append((*key, place, text, whole and starts, starts, key[1] == 0 and starts and not seen))
            seen = seen or starts

        for k, line, first in _lines(batches):
            if k != key:
                if lines:
                    close(False)
                key, lines, inside, at, begun, seen = k, [], first, 0, 0, False
                starts = not inside
            if not lines:
                begun = at
            lines.append(line.removesuffix(end))
            at += len(line) + 1
            inside = ends_inside(line, inside, sep)
            if not inside:
                close(True)
                lines, starts = [], True
            if len(out) >= BATCH_ROWS:
                yield _batch(out)
                out = []
        if lines:
            close(False)
        if out:
            yield _batch(out)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def first_states(maps: DataFrame) -> DataFrame:
    """(file, block, inside): the state in which each block's first line starts.

    A block that maps both states to one forgets what came before; since the
    last such block the state changes with every block that swaps the two.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct("block", F.col("from_out").alias("state")))
    swaps = (F.col("from_out") & ~F.col("from_in")).cast("int")
    marked = maps.withColumns({"_fix": F.last(fixed, ignorenulls=True).over(before),
                               "_swaps": F.coalesce(F.sum(swaps).over(before), F.lit(0)), "_swap": swaps})
    # swaps counted up to and with the fixing block, to take them off (a fixing block is no swap)
    own = marked.select("file", F.col("block").alias("_at"), F.col("_swaps").alias("_base"))
    joined = marked.withColumn("_at", F.col("_fix.block")).join(own, ["file", "_at"], "left")
    odd = (F.col("_swaps") - F.coalesce("_base", F.lit(0))) % 2 == 1
    return joined.select("file", "block", (F.coalesce(F.col("_fix.state"), F.lit(False)) != odd).alias("inside"))


def read_records(spark: SparkSession, files: list[str], sep: str, encoding: str = "UTF-8", crlf: bool = False) -> DataFrame:
    """(file, position, record): the records of ``files`` without their headers, positions growing along each file.

    For encodings that keep ASCII as it is, and lines that end with a newline;
    with ``crlf`` a carriage return before it belongs to the line end, within
    quotes too.
    """
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))
    mark = sep.encode(encoding)
    states = first_states(lines.mapInArrow(_block_maps(mark), _ddl(_MAP)))
    placed = lines.join(F.broadcast(states), ["file", "block"], "left")      # a row a block
    placed = placed.withColumn("inside", F.coalesce("inside", F.raise_error(F.lit("unknown block: the file changed")).cast("boolean")))
    pieces = placed.mapInArrow(_block_records(mark, crlf), _ddl(_PIECE))
    order = Window.partitionBy("file").orderBy("block", "position")
    parts = pieces.filter(~F.col("whole")).withColumn("_record", F.sum(F.col("starts").cast("int")).over(order))
    joined = parts.groupBy("file", "_record").agg(
        F.min("position").alias("position"), F.bool_or("header").alias("header"),
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("_parts")).select(
        "file", "position", "header", F.aggregate(
            "_parts", F.lit(None).cast("binary"),
            lambda text, p: F.when(text.isNull(), p["record"]).otherwise(F.concat(text, F.lit(b"\n"), p["record"]))).alias("record"))
    whole = pieces.filter("whole").select("file", "position", "header", "record")
    return whole.unionByName(joined).filter(~F.col("header")).select(
        "file", "position", F.decode("record", encoding).alias("record"))


def read_split_csv(spark: SparkSession, files: list[str], names: tuple[str, ...], sep: str, encoding: str,
                   crlf: bool, drop_malformed: bool, file_column: str, position_column: str) -> DataFrame:
    """String columns ``names`` of ``files`` and the two place columns, like the one-split reader gives them."""
    bad = "_malformed"
    while bad in names:
        bad += "_"
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in (*names, bad))
    options = {"sep": sep, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": bad, "maxCharsPerColumn": "-1"}
    records = read_records(spark, files, sep, encoding, crlf)
    parsed = records.select(F.from_csv("record", schema, options).alias("r"), F.col("file").alias(file_column),
                            F.col("position").alias(position_column))
    if drop_malformed:
        parsed = parsed.filter(F.col("r").getField(bad).isNull())
    return parsed.select(*[F.col("r").getField(n).alias(n) for n in names], file_column, position_column)

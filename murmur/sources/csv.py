"""Tolerant CSV reading for complaint files and folders of them.

Every column is read as a string (no inference).  Each file is judged by
itself, by all of its bytes:

* encoding: a byte-order mark or NUL characters -> UTF-16; every line valid
  UTF-8 -> UTF-8 (a BOM is dropped by the reader); anything else ->
  ISO-8859-1, which decodes every byte (as latin1 does when it is tried after
  UTF-8).  The lines are checked in one distributed pass over the input;
* separator: the comma if the file's header splits on it, else the first of
  ``;``, tab and ``|`` that occurs in the header;
* header: the file's own, so columns may stand in any order in each file.

Files alike in all three are read together, by name and with quoted newlines
and doubled quotes, and the groups are united by column name.  A file is one
task up to ``split_over`` bytes; larger ones are read by many (``csv_splits``),
but for UTF-16 and for lines that end with a bare carriage return.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.constants import ALTERNATE_SEPARATORS, COLUMN_SYNONYMS, COMPLAINT_COLUMNS
from murmur.sources.csv_splits import read_split_csv

HEADER_CHUNK = 1 << 16
FILE_COLUMN, POSITION_COLUMN = "_file", "_position"
SPLIT_OVER = 4 << 30       # one task reads some 45 MB a second; blocks cost several times the CPU time


def list_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The data files of paths, globs and folders, in name order."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for one in [path] if isinstance(path, str) else path:
        p = jvm.org.apache.hadoop.fs.Path(one)
        fs = p.getFileSystem(conf)
        found = fs.globStatus(p) or []
        if not len(found):
            raise FileNotFoundError(one)
        for st in found:
            inner = fs.listStatus(st.getPath()) if st.isDirectory() else [st]
            out += [s.getPath().toString() for s in inner
                    if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return sorted(set(out))


def header_bytes(spark: SparkSession, path: str) -> bytes:
    """The file's first record: read on until a line end outside quotes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        data = b""
        while chunk := bytes(stream.readNBytes(HEADER_CHUNK)):
            data += chunk
            quotes = 0
            for line in data.split(b"\n")[:-1]:
                quotes += line.count(b'"')
                if quotes % 2 == 0 and line.strip(b"\r\x00\xef\xbb\xbf\xff\xfe"):
                    return data
        return data
    finally:
        stream.close()


def detect_encodings(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """file -> encoding, from every line of every file (the text source hands out raw bytes)."""
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), "value")
    row = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
                                    F.bool_or(F.contains("value", F.lit("\0"))).alias("nul")).collect()  # a row a file
    norm = {_plain(r["file"]): r for r in row}
    out = {}
    for f in files:
        r = norm.get(_plain(f))
        head = header_bytes(spark, f)[:2]
        if head in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
            out[f] = "UTF-16"
        elif r is not None and r["nul"]:
            out[f] = "UTF-16LE" if head[1:2] == b"\0" else "UTF-16BE"
        else:
            out[f] = "UTF-8" if r is None or r["utf8"] else "ISO-8859-1"
    return out


def _split_lines(spark: SparkSession, path: str, over: int) -> str | None:
    """The line end of a file of more than ``over`` bytes; None for smaller ones and bare carriage returns."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() <= over:
        return None
    head = header_bytes(spark, path)
    first = head[:head.find(b"\n") + 1]
    return None if b"\r" in first.replace(b"\r\n", b"") else "\r\n" if first.endswith(b"\r\n") else "\n"


def _plain(uri: str) -> str:
    from urllib.parse import unquote, urlparse
    return unquote(urlparse(uri).path)


def sniff_separator(header: str, default: str = ",") -> str:
    """The separator that reads most known column names out of the header, then fewest torn quotes, then most columns; ties: ``default``."""
    known = {*COMPLAINT_COLUMNS, *COLUMN_SYNONYMS, *(n for names in COLUMN_SYNONYMS.values() for n in names)}

    def columns(sep: str) -> tuple[int, int, int]:
        names = [n.strip().lower().replace(" ", "_") for n in next(csv.reader([header], delimiter=sep), [])]
        return len(known & set(names)), -sum('"' in n for n in names), len(names)

    return max([default, *ALTERNATE_SEPARATORS], key=columns)


def _header(spark: SparkSession, path: str, encoding: str, sep: str | None) -> tuple[str, tuple[str, ...]]:
    text = header_bytes(spark, path).decode(encoding, errors="replace").lstrip("﻿")
    first = next((x for x in io.StringIO(text) if x.strip()), "")
    sep = sep or sniff_separator(first)
    names = next(csv.reader(io.StringIO(text.lstrip("\r\n")), delimiter=sep), [])
    seen: dict[str, int] = {}
    unique = []
    for i, n in enumerate(names):
        n = n.strip() or f"_c{i}"
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
        unique.append(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}")
    return sep, tuple(unique)


def read_complaints_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None, sep: str | None = None,
                        drop_malformed: bool = False, with_position: bool = False,
                        split_over: int = SPLIT_OVER) -> DataFrame:
    """All-string DataFrame of a complaint CSV file, folder or list of files.

    ``with_position`` adds ``_file`` and ``_position``: together they give the
    order of the rows, by file name and place in the file.  A column that a
    file does not have is null in its rows.
    """
    files = list_files(spark, path)
    encodings = dict.fromkeys(files, encoding) if encoding else detect_encodings(spark, files)
    groups: dict[tuple, list[str]] = defaultdict(list)
    for f in files:
        lines = _split_lines(spark, f, split_over) if encodings[f] in ("UTF-8", "ISO-8859-1") else None
        groups[(encodings[f], *_header(spark, f, encodings[f], sep), lines)].append(f)
    out = None
    for (enc, s, names, lines), members in groups.items():
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        if not names:
            continue
        if lines:
            df = read_split_csv(spark, members, names, s, enc, lines == "\r\n", drop_malformed, FILE_COLUMN, POSITION_COLUMN)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
            continue
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", enc)
              .option("sep", s).option("quote", '"').option("escape", '"').option("multiLine", True)
              .option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").csv(members))
        # a multi-line file is one split, so ids grow along the file
        df = df.select("*", F.col("_metadata.file_path").alias(FILE_COLUMN),
                       F.monotonically_increasing_id().alias(POSITION_COLUMN))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no header in {path}")
    return out if with_position else out.drop(FILE_COLUMN, POSITION_COLUMN)


def read_text_complaints(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON complaint texts by file suffix; other formats are refused.

    JSON lines are read splittably; a file that starts with ``[`` is one array.
    """
    low = path.lower()
    if low.endswith(".csv"):
        return read_complaints_csv(spark, path)
    if low.endswith((".json", ".jsonl")):
        array = any(header_bytes(spark, f).lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"[") for f in list_files(spark, path))
        return spark.read.option("multiLine", array).json(path)
    raise ValueError(f"unsupported file format: {path}")

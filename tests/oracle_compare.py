"""Run a Spark query and its DuckDB oracle SQL side by side and compare.

Comparison mirrors the driver's gate: columns sorted by name, row count,
column types (mapped to a common vocabulary) and an order-insensitive multiset
of rows.  Doubles are compared after rounding to ``digits`` decimals.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
from collections import Counter

import duckdb

from murmur.sources.tables import DRIVER_TABLES

_SPARK_TYPES = {
    "string": "str", "bigint": "int", "int": "int32", "integer": "int32",
    "double": "float", "float": "float32", "date": "date", "timestamp_ntz": "ts",
    "timestamp": "ts", "boolean": "bool", "smallint": "int16", "tinyint": "int8",
}
_DUCK_TYPES = {
    "VARCHAR": "str", "BIGINT": "int", "INTEGER": "int32", "DOUBLE": "float",
    "FLOAT": "float32", "DATE": "date", "TIMESTAMP": "ts", "BOOLEAN": "bool",
    "SMALLINT": "int16", "TINYINT": "int8",
}


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, digits) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _spark_type(dt) -> str:
    s = dt.simpleString()
    return _SPARK_TYPES.get(s, s)


def _duck_type(t) -> str:
    s = str(t)
    return _DUCK_TYPES.get(s, s)


def compare(spark_df, con, sql: str, digits: int = 6):
    """Return (ok, message)."""
    s_cols = spark_df.columns
    s_types = {f.name: _spark_type(f.dataType) for f in spark_df.schema.fields}
    s_rows = spark_df.collect()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    d_types = {c: _duck_type(t) for c, t in zip(d_cols, con.execute(f"DESCRIBE {sql}").fetchall() and
                                                    [r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()])}
    msgs = []
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    cols = sorted(s_cols)
    for c in cols:
        if s_types[c] != d_types[c]:
            msgs.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
    if len(s_rows) != len(d_rows):
        msgs.append(f"rows: spark={len(s_rows)} duck={len(d_rows)}")
    si = [s_cols.index(c) for c in cols]
    di = [d_cols.index(c) for c in cols]
    sc = Counter(tuple(_norm(r[i], digits) for i in si) for r in s_rows)
    dc = Counter(tuple(_norm(r[i], digits) for i in di) for r in d_rows)
    if sc != dc:
        only_s = list((sc - dc).elements())[:5]
        only_d = list((dc - sc).elements())[:5]
        msgs.append(f"values differ ({sum((sc - dc).values())} vs {sum((dc - sc).values())} rows); "
                    f"cols={cols}\n  spark-only: {only_s}\n  duck-only: {only_d}")
    return (not msgs), ("; ".join(msgs) if msgs else f"ok ({len(s_rows)} rows)")

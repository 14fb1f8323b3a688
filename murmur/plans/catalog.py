"""Registry of named queries: a Spark plan and its DuckDB oracle SQL.

Every query reads the driver tables under ``sf_dir`` (through the complaint
views of ``murmur.sources.tables`` or the text tables directly) and runs over
all of them: backfill operators compute every date present in the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from murmur.plans import queries_core, queries_enrich, queries_ingest, queries_ops, queries_periods, queries_reports, queries_state, queries_stream, queries_text, queries_views  # noqa: F401,E501

"""Independent DuckDB formulations of the registered queries.

Each SQL here is written the direct way (range joins, correlated grouping)
rather than the way the Spark plan computes it, so agreement between the two
is a real check.  Arithmetic that must match to the last bit (sample std from
exact sums, round half up, the Student-t closed form) uses the same formula.
"""

from __future__ import annotations

from murmur.constants import DIMENSIONS
from murmur.sources.tables import complaints_view_sql


def with_complaints(view: str = "complaints_ev", *ctes: str) -> str:
    items = [complaints_view_sql(view, "c"), *ctes]
    return "WITH " + ",\n".join(items) + "\n"


def long_sql(src: str = "c", include_total: bool = False, extra: str = "") -> str:
    parts = [f"SELECT '{name}' AS dimension, CAST({col} AS VARCHAR) AS dimension_key, "
             f"sr_open_dt AS day{extra} FROM {src}" for name, col in DIMENSIONS.items()]
    if include_total:
        parts.append(f"SELECT 'Total' AS dimension, 'Total' AS dimension_key, sr_open_dt AS day{extra} FROM {src}")
    return "\n  UNION ALL ".join(parts)


def dc_cte(name: str = "dc", src: str = "c", include_total: bool = False) -> str:
    return (f"{name} AS (SELECT dimension, dimension_key, day, count(*) AS n FROM (\n  "
            f"{long_sql(src, include_total)}) GROUP BY dimension, dimension_key, day)")


def std_sql(c: str, s: str, ss: str) -> str:
    return (f"CASE WHEN {c} > 1 THEN sqrt(greatest(0.0E0, ({c} * {ss} - {s} * {s}) / ({c} * ({c} - 1)))) "
            f"ELSE 0.0E0 END")


def avg_sql(c: str, s: str) -> str:
    return f"CASE WHEN {c} <> 0 THEN CAST({s} AS DOUBLE) / {c} ELSE 0.0E0 END"

"""Every registered query against its DuckDB oracle (the driver's gate, on sf0.001)."""

import os

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from murmur.plans import catalog
from oracle_compare import compare, duck_connect

catalog.load_all()
QUERIES, ORACLE = dict(catalog.QUERIES), dict(catalog.ORACLE)        # the optional subpackage has tests of its own


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


def test_every_query_has_an_oracle_or_is_documented():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"trend_drilldown"}, rows_only
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["anomaly_date", "dimension", "dimension_key"]
    assert df.count() >= 0

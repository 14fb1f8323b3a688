"""Every registered corpus query has SQL, which is compared here, or a brute-force test named here."""

from __future__ import annotations

import importlib
import os

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from murmur.llm import queries
from oracle_compare import compare, duck_connect

BRUTE_FORCE = {
    "op1_substring_dedup": "test_passages", "op2_warc": "test_operators", "op3_benchmark_decontamination": "test_operators",
    "op5_lm_scoring": "test_operators", "op6_simhash_near_dedup": "test_operators", "op7_language_id": "test_operators",
    "op12_embedding_whitening": "test_whitening", "op13_ngram_jaccard_join": "test_jaccard_join",
}


def test_every_query_has_sql_or_a_brute_force_test():
    assert set(queries.QUERIES) - set(queries.ORACLE) == set(BRUTE_FORCE)
    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) >= {"pipeline"}          # test_pipeline
    for module in set(BRUTE_FORCE.values()):
        importlib.import_module(module)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    ok, msg = compare(queries.QUERIES[name](spark, SF_SMALL), duck_connect(SF_SMALL), queries.ORACLE[name])
    assert ok, msg

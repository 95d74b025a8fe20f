"""Every registered query against its DuckDB oracle on the smallest data set
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as entry
from prlens.plans import catalog
from prlens.plans.oracle import compare, duck_connection

from conftest import SF_SMALL

QUERIES = {k: v for k, v in entry.queries().items() if k in catalog.QUERIES}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "decision" in df.columns

"""Every registered query against its DuckDB twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, sf, name):
    problem, _ = differences(spark, con, sf, QUERIES[name], ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

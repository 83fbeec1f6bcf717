"""Every registered query against its SQL oracle on the smallest test tables."""

import importlib.util
import os

import pytest

from conftest import ROOT, SF_SMALL
from oracle import compare, duck

_spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry)

OPTIONAL = set(entry._optional()[0])  # tested in tests/llm; SQL cannot express all of them
QUERIES = {k: q for k, q in entry.queries().items() if k not in OPTIONAL}
ORACLES = {k: q for k, q in entry.oracle_sql().items() if k not in OPTIONAL}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["team_name", "total_wins"]
    assert df.count() > 0

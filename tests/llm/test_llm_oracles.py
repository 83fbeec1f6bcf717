"""Queries that SQL can express, against their SQL."""

import pytest
from llm_session import workers  # noqa: F401
from oracle import compare, duck

from crease.llm.queries import llm_oracles, llm_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_matches_sql(workers, name):
    ok, msg = compare(llm_queries()[name](workers, SF), duck(SF), llm_oracles()[name])
    assert ok, msg


def test_registered_beside_the_others():
    import __spark_entry__ as entry

    assert set(llm_queries()) | {"pipeline"} <= set(entry.queries())
    assert set(llm_oracles()) <= set(entry.oracle_sql())

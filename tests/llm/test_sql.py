"""Queries of the package against their SQL, on whole tables at the smallest scale."""

import pytest

from tests.harness import compare
from tidemark.llm.queries import QUERIES


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query(spark, con, folder, name):
    _, rows, problem = compare(spark, con, folder, QUERIES[name])
    assert problem is None, problem
    assert rows > 0

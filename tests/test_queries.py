"""Every registered query against its SQL, on whole tables at the smallest scale."""

import pytest

from tests.harness import compare
from tidemark.plans import QUERIES

# These share one backtest each and state the same tables; the full set runs in the harness.
HEAVY = {"buy_and_hold", "period_metrics", "backtest_status", "bootstrap_interval"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in HEAVY])
def test_query(spark, con, folder, name):
    _, rows, problem = compare(spark, con, folder, QUERIES[name])
    assert problem is None, problem
    if name != "event_alerts":
        assert rows > 0

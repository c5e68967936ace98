"""Registered queries: each names what it computes and, where SQL can say it, the same in SQL."""

from tidemark.plans.registry import QUERIES  # noqa: F401
from tidemark.plans import market  # noqa: F401,E402
from tidemark.plans import backtests  # noqa: F401,E402
from tidemark.plans import gating  # noqa: F401,E402
from tidemark.plans import texts  # noqa: F401,E402
from tidemark.plans import ledgers  # noqa: F401,E402
from tidemark.plans import models  # noqa: F401,E402
from tidemark.plans import alerting  # noqa: F401,E402
from tidemark.plans import extras  # noqa: F401,E402
from tidemark.plans import governance  # noqa: F401,E402
from tidemark.plans import nulls  # noqa: F401,E402

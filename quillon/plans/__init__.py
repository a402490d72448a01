"""The query catalogue."""

from quillon.plans import aggregates, learning, legislation, records, relational, search, texts  # noqa: F401  they register their queries
from quillon.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

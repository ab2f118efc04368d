"""All queries of the engine, apart from the training-data operators."""

from .plans import extra_queries, format_queries, function_queries, interval_queries, more_queries, relational_queries  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""All named queries."""

from trajflow.plans import corpora, graphs, metrics, relations, steps  # noqa: F401
from trajflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

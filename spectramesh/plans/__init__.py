"""Registered queries over the library's operators, with their SQL, and whole jobs over mesh files."""

from spectramesh.plans import file_queries, iterative_queries  # noqa: F401  (they register their queries)
from spectramesh.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]

"""All queries of the library."""

from . import contract_queries, history_queries, scoring_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "contract_queries", "history_queries", "scoring_queries"]

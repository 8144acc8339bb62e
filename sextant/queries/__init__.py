"""All registered queries; importing a module registers its own."""

from . import graph_queries, lexical_queries, policy_queries, sync_queries, text_queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "lexical_queries", "policy_queries", "sync_queries", "text_queries"]

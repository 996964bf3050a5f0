"""Whole queries composed of operators, and their registry."""

from quern.plans import graph_queries, index_queries, module_queries, page_queries, seam_queries, search_queries, store_queries, stream_queries, text_queries  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

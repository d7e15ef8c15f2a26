"""Registered queries with their SQL, and the composed analysis."""

from . import overview_queries, pipeline_queries, privacy_queries, response_queries, search_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "overview_queries", "pipeline_queries", "privacy_queries", "response_queries", "search_queries"]

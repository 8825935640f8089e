"""Registered queries over the driver's tables."""

from . import linking_queries, scalar_queries, text_queries, view_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "linking_queries", "scalar_queries", "text_queries", "view_queries"]

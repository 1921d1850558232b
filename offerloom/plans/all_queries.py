"""Importing this module registers every query."""

from . import extraction_queries, lifecycle_queries, page_queries, profile_queries, serving_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

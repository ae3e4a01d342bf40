"""Queries over the provided tables, one or more per operator, with their SQL twins."""

from . import catalog_queries, log_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

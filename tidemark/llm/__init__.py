"""Operators for training-data corpora; nothing else in the library imports them."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

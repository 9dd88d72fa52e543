"""Operators for training-data pipelines."""

from .queries import QUERIES, STATEMENTS

__all__ = ["QUERIES", "STATEMENTS"]

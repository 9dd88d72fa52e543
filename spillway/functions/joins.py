"""Joins between tables that both grow."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_merge(frame: DataFrame) -> DataFrame:
    """``frame`` marked so that its join shuffles and merges both sides.

    Whether Spark broadcasts a side goes by the bytes of its files or columns before anything is
    decoded; well packed files of a few megabytes hold a million rows, which the driver would collect
    and hash.  For joins on an application or a person; tables that stay small need no mark.
    """
    return frame.hint("merge")

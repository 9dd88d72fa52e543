"""How well scores tell outcomes apart, exactly, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import columns
from .order_statistics import ranked


def area_under_curve(rows: DataFrame, score: str, label: str) -> DataFrame:
    """``n, positives, auc`` of the SQL ``score`` for the 0/1 SQL ``label``, one row.

    The share of pairs of a positive and a negative row in which the positive one has the higher
    score, equal scores counting half, from the rank sum of the positives; no pair is formed.  Rows
    without score or label do not count; NULL where one kind of row is missing.
    """
    known = rows.selectExpr(f"CAST({score} AS DOUBLE) AS score", f"CAST({label} AS BIGINT) AS label")
    per_score = (
        ranked(known.where("score IS NOT NULL AND label IS NOT NULL"), "score", "first", descending=False)
        .groupBy("first")
        .agg(*columns(["count(1) AS n", "sum(label) AS positives"]))
    )
    # Twice the mean rank of equal scores is a whole number: no rounding in the sums.
    sums = per_score.agg(
        *columns(
            [
                "coalesce(sum(n), 0L) AS n",
                "coalesce(sum(positives), 0L) AS positives",
                "sum(CAST(positives AS DECIMAL(19)) * (2 * first + n - 1)) AS ranks",
            ]
        )
    )
    own = "CAST(positives AS DECIMAL(19)) * (positives + 1)"
    return sums.selectExpr(
        "n",
        "positives",
        f"CAST(ranks - {own} AS DOUBLE) / nullif(2D * positives * (n - positives), 0D) AS auc",
    )


def calibration(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """``bin, low, high, n, mean_score, share``: rows by equal steps of a score from 0 to 1, and the
    share that turned out positive.  A score of 1 belongs to the last bin; rows without score or
    label, or with a score out of range, do not count; empty bins have no row."""
    place = f"least(CAST(floor(score * {bins}) AS INT), {bins - 1})"
    return (
        rows.selectExpr(f"CAST({score} AS DOUBLE) AS score", f"CAST({label} AS BIGINT) AS label")
        .where("score BETWEEN 0 AND 1 AND label IS NOT NULL")
        .groupBy(*columns([f"{place} AS bin"]))
        .agg(*columns(["count(1) AS n", "avg(score) AS mean_score", "avg(CAST(label AS DOUBLE)) AS share"]))
        .selectExpr("bin", f"bin / {bins}D AS low", f"(bin + 1) / {bins}D AS high", "n", "mean_score", "share")
        .orderBy("bin")
    )

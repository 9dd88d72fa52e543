"""Distinct entities kept up to date load by load, without reading the log again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import StageLadder, StageLog
from ..operators.reach import WORD_KEY, merged_words, reach_between, reach_words, rolling_reach
from ..sources.partitions import merge, read_partitions


class StandingReach:
    """Words of :func:`reach_words` in a folder, partitioned by day (or month, see ``period``).

    A load merges its own words into the days it has events of, and leaves the others' files.  Sets
    don't depend on order or repeats, so loads may come late, in any order, and twice.
    """

    def __init__(self, spark: SparkSession, folder: str, ladder: StageLadder, period: str = "day"):
        self.spark, self.folder, self.ladder, self.period = spark, folder, ladder, period

    def load(self, log: StageLog) -> list:
        """Merge a log's events; returns the days it touched."""
        return merge(reach_words(log, self.period), self.folder, "on_day", WORD_KEY, merged_words)

    def words(self) -> DataFrame:
        like = "on_day DATE, stage_order INT, word BIGINT, bits BIGINT"
        return read_partitions(self.spark, self.folder, self.spark.createDataFrame([], like))

    def between(self, first: str, last: str) -> DataFrame:
        return reach_between(self.words(), self.ladder.stages, first, last)

    def rolling(self, days: int = 7) -> DataFrame:
        return rolling_reach(self.words(), days)

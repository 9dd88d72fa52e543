"""How many partitions a stream's state is spread over."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTING = "spark.sql.shuffle.partitions"


@contextmanager
def state_partitions(spark: SparkSession, count: int | None = None) -> Iterator[None]:
    """Queries started inside keep ``count`` state partitions, by default one per core.

    The number is fixed when a query first starts and kept in its checkpoint; adaptive execution
    does not merge state partitions, and every one costs a few files per batch.
    """
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, str(count or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before)

"""Steps that are written once and read back, and the check in front of a broadcast."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import remove_folder, shared_folder

#: Spark removes an execution's shuffle files when it ends, not when the driver next collects garbage.
_FILES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; nothing else reads them."""
    before = spark.conf.get(_FILES_END, None)
    spark.conf.set(_FILES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILES_END)
        else:
            spark.conf.set(_FILES_END, before)


def stored(frame: DataFrame, purpose: str, paths: list[str] | None = None) -> DataFrame:
    """``frame`` written as Parquet to the folder all executors share, and read back.

    A step that is used twice is computed once this way, its lineage ends here, and a lost executor
    costs the readers nothing.  The folder's path is appended to ``paths``, for :func:`remove_all`.
    """
    path = shared_folder(frame.sparkSession, purpose)
    with shuffles_end(frame.sparkSession):
        frame.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove_all(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored steps that nothing reads any more."""
    for path in paths:
        remove_folder(spark, path)
    paths.clear()


def small(frame: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``frame`` marked for broadcast if it has at most ``most_rows`` (narrow) rows, else as it is:
    the join is then Spark's shuffled one, with the same rows.  Give a stored frame."""
    return F.broadcast(frame) if frame.count() <= most_rows else frame


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.  Only matters where it
    is neither installed nor in the workers' own path, as in a local run from another folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)

"""Tables in partition folders, reloaded a partition at a time.

A load only rewrites the partitions it touches: those its rows belong to, and those that hold older
versions of its rows.  The new content is written to an intermediate folder first and then put in
place by a dynamic partition overwrite, so a load never reads what it overwrites, and all other
partitions keep their files.  Running a load again gives the same table, whether the first run
ended or broke off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, name
from .scratch import remove_folder, shared_folder


def read_partitions(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path`` with the columns of ``like``; empty where nothing was written yet."""
    if not _folder(spark, path, "exists"):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def overwrite_partitions(frame: DataFrame, path: str, by: str, order: list[str] | None = None) -> None:
    """Replace the partitions of ``path`` that ``frame`` has rows for, and leave the others.

    Rows are dealt in ranges of ``by`` and ``order``, so that a large partition is several files and
    a small one not many, and sorted so that filters on ``order`` skip row groups.
    """
    keys = [by, *(order or [])]
    (
        frame.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key: the one with the greatest ``version``, of several the greatest by the other
    columns from left to right.  A row without a version is older than any.  A key with very many
    versions leaves each task as one row."""
    others = [name(c) for c in rows.columns if c not in key and c != version]
    row = f"max(struct({', '.join([name(version), *others])})) AS newest"
    newest = rows.groupBy(*key).agg(*columns([row]))
    return newest.select(*key, "newest.*").select(*rows.columns)


def merge_latest(new: DataFrame, path: str, by: str, key: list[str], version: str) -> list:
    """Merge ``new`` into the table at ``path``, latest version of a key wins; see :func:`merge`."""
    return merge(new, path, by, key, lambda rows: latest(rows, key, version))


def merge(
    new: DataFrame, path: str, by: str, key: list[str], combine: Callable[[DataFrame], DataFrame]
) -> list:
    """Merge ``new`` into the table at ``path``, partitioned by the column ``by``.

    ``combine`` gets the new rows together with all rows of the touched partitions, and gives one row
    per ``key``, with the same columns.  It has to be indifferent to order and repeats, which makes a
    repeated load change nothing.  A key may move to another partition, unless ``by`` is part of it;
    a partition left without rows is removed.  Returns the touched partitions' values, in no order.  Their number is bounded
    by the table's partitions, which the driver lists in any case.
    """
    spark = new.sparkSession
    staged, merged = shared_folder(spark, "load"), shared_folder(spark, "merged")
    new.write.parquet(staged)
    arrived = spark.read.schema(new.schema).parquet(staged)
    table = read_partitions(spark, path, arrived)
    touched = arrived.select(by)
    if by not in key:
        # Only the key column of the table is read to find out where older versions lie.
        old = table.select(by, *key).join(arrived.select(*key).distinct(), key, "left_semi")
        touched = touched.union(old.select(by))
    values = [r[0] for r in touched.distinct().collect()]
    if not values:
        remove_folder(spark, staged)
        return []
    rows = arrived.unionByName(table.where(_one_of(by, values)))
    combine(rows).select(*new.columns).write.parquet(merged)
    done = spark.read.schema(new.schema).parquet(merged)
    left = {r[0] for r in done.select(by).distinct().collect()}
    overwrite_partitions(done, path, by, [k for k in key if k != by])
    for value in set(values) - left:
        _drop_partition(spark, path, by, value)
    for folder in (staged, merged):
        remove_folder(spark, folder)
    return values


def _one_of(by: str, values: list):
    known = [v for v in values if v is not None]
    test = F.col(by).isin(known) if known else F.lit(False)
    return test | F.col(by).isNull() if None in values else test


def _drop_partition(spark: SparkSession, path: str, by: str, value) -> None:
    text = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
    _folder(spark, f"{path}/{by}={text}", "delete", True)


def _folder(spark: SparkSession, path: str, action: str, *arguments):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return getattr(system, action)(place, *arguments)

"""Where jobs put intermediate files: a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str, base: str | None = None) -> str:
    """A new path under ``base``, by default the session's ``spark.checkpoint.dir``.

    Where that is unset the path lies in the session's warehouse, which every session has and all
    executors reach; the rule is the same on every master.  Whoever asked for the path removes it,
    see :func:`remove_folder`.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    return f"{base.rstrip('/')}/spillway-{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`shared_folder` through Spark's own file system."""
    if "/spillway-" not in path:
        raise ValueError(f"{path} is not an intermediate folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

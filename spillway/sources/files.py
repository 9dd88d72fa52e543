"""Reading and writing the loan book: delimited files, Parquet folders, bucketed tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns
from .book import LoanBook
from .schemas import CLUSTERING, DEFAULTS, NAMES, SCHEMAS


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ","
) -> DataFrame:
    """Files with one header line, read by position under a declared schema.

    The header's names do not matter, the files are split across tasks, and a row that does not
    fit the schema fails the load.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", delimiter)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Column defaults for empty fields, and stage and category names in one spelling."""
    for name in NAMES.get(table, ()):
        frame = frame.withColumn(name, F.lower(F.trim(name)))
    defaults = DEFAULTS.get(table)
    return frame.na.fill(defaults) if defaults else frame


def load_delimited(spark: SparkSession, path: str, table: str, delimiter: str = ",") -> DataFrame:
    """One of the four tables from delimited files."""
    return conform(read_delimited(spark, path, SCHEMAS[table], delimiter), table)


def read_delimited_book(spark: SparkSession, folder: str) -> LoanBook:
    """``<folder>/<table>.csv`` for each of the four tables."""
    return LoanBook(
        {t: partial(load_delimited, spark, f"{folder}/{t}.csv", t) for t in SCHEMAS}
    )


def write_parquet_book(book: LoanBook, folder: str) -> None:
    """Replace ``<folder>/<table>`` for each table.

    Rows are clustered by the column reports group and join on, and events also sorted by stage,
    so that stage filters skip row groups by their statistics.
    """
    for table, frame in book.tables().items():
        key = CLUSTERING[table]
        order = ["stage", key] if table == "application_events" else [key]
        clustered = frame.repartitionByRange(*_spread(frame, key)).sortWithinPartitions(*order)
        clustered.write.mode("overwrite").parquet(f"{folder}/{table}")


def read_parquet_book(spark: SparkSession, folder: str) -> LoanBook:
    return LoanBook(
        {t: partial(spark.read.schema(s).parquet, f"{folder}/{t}") for t, s in SCHEMAS.items()}
    )


#: Rows of the largest table in a bucket, about: what a task holds of it while it reduces events.
BUCKET_ROWS = 1 << 20


def write_bucketed_book(
    book: LoanBook, database: str, buckets: int, split: int = 8, rows: int = BUCKET_ROWS
) -> None:
    """Managed tables bucketed by their clustering column.

    ``buckets`` is the least number; it is doubled until a bucket has about ``rows`` rows of the
    largest table or fewer, so that a task's share does not grow with the tables.

    Events and applications share the application buckets: reports that reduce events per
    application and join the application then run without shuffling either table.  A bucket is
    read by one task, so where one application may own a large share of all events, keep the
    Parquet folders or read with ``spark.sql.sources.bucketing.enabled=false``.

    Rows are gathered per bucket before the write, events in up to ``split`` parts per bucket, so
    that neither many small files nor one very long task comes of it.
    """
    largest = max(frame.count() for frame in book.tables().values())
    while buckets * rows < largest:
        buckets *= 2
    for table, frame in book.tables().items():
        key = CLUSTERING[table]
        parts = [f"pmod(hash({key}), {buckets})"]
        if "event_id" in frame.columns:
            parts.append(f"pmod(hash(event_id), {split})")
        (
            frame.repartition(*columns(parts))
            .write.mode("overwrite")
            .format("parquet")
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(f"{database}.{table}")
        )


def read_table_book(spark: SparkSession, database: str) -> LoanBook:
    return LoanBook({t: partial(spark.table, f"{database}.{t}") for t in SCHEMAS})


def write_report(report: DataFrame, path: str, format: str = "parquet") -> None:
    """Store a report's rows; CSV output carries a header line."""
    writer = report.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def _spread(frame: DataFrame, key: str):
    """Range keys that still split a key shared by many rows: the row's own identity comes last."""
    return [key, "event_id"] if "event_id" in frame.columns else [key]

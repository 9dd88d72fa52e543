"""Texts as Arrow batches of bytes, and the columns every operator reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(doc_id: str, parts: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 1; a null id is never held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % parts == 1, F.lit(False))


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as the empty text."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def schema_of(**fields: T.DataType | str) -> T.StructType:
    """A schema from names and types (``T`` objects or DDL names)."""
    kinds = {n: T._parse_datatype_string(k) if isinstance(k, str) else k for n, k in fields.items()}
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def id_type(docs: DataFrame, doc_id: str) -> T.DataType:
    return docs.schema[doc_id].dataType


def rows_per_text(
    docs: DataFrame,
    passed: list[Column],
    text: str,
    measure: Callable[[list[bytes]], dict[str, Iterable]],
    schema: T.StructType,
) -> DataFrame:
    """One row per document: ``passed`` columns first, then what ``measure`` gives for the texts."""
    names, first = schema.fieldNames(), len(passed)
    kept = [c.alias(f"_{i}") for i, c in enumerate(passed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(texts_of(batch.column(batch.num_columns - 1)))
            columns = batch.columns[:-1] + [_array(found[n]) for n in names[first:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def rows_kept(docs: DataFrame, text: str, keep: Callable[[list[bytes]], Iterable[bool]]) -> DataFrame:
    """The documents, all columns as they were, whose text ``keep`` accepts."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(texts_of(batch.column(place))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

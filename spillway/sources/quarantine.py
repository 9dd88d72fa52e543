"""Loads that survive bad rows: what fits goes on, the rest is set aside with its reasons.

Files are read once.  A row that does not parse under the declared schema, or breaks a rule that
can be judged on the row alone, is stored with its reasons and its text; every other row is stored
as loaded.  Accepted and rejected rows together are the input, row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .files import conform
from .schemas import CONSTRAINTS, SCHEMAS

#: The reason of a row that does not parse: too few or too many fields, or a value of another type.
MALFORMED = "malformed"
_LINE, _REASONS = "_line", "_reasons"


def load_or_reject(
    spark: SparkSession, path: str, table: str, into: str, rules: Sequence | None = None, delimiter: str = ","
) -> None:
    """Load delimited files with a header into ``into``, see :func:`accepted` and :func:`rejected`.

    ``rules`` are row rules (not null, in a range, one of some values), by default the table's; rules
    over several rows, as on keys, are for the constraint report afterwards.  Defaults and spellings
    are applied before the rules.  A malformed row is not judged by them.  Loading again replaces
    the load; a load that breaks off leaves nothing that :func:`accepted` would read as whole.
    """
    judged = [r for r in (CONSTRAINTS[table] if rules is None else rules) if hasattr(r, "broken")]
    schema = T.StructType([*SCHEMAS[table].fields, T.StructField(_LINE, T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", delimiter)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _LINE)
        .csv(path)
    )
    reasons = ", ".join(f"IF({rule.broken()}, {text(rule.rule)}, NULL)" for rule in judged)
    found = f"array_compact(array({reasons}))" if judged else "CAST(array() AS array<string>)"
    whole = f"IF({_LINE} IS NOT NULL, array({text(MALFORMED)}), {found})"
    (
        conform(raw, table)
        .withColumn(_REASONS, F.expr(whole))
        .withColumn("rejected", F.expr(f"size({_REASONS}) > 0"))
        .write.mode("overwrite")
        .partitionBy("rejected")
        .parquet(into)
    )


def _stored(spark: SparkSession, into: str, table: str) -> DataFrame:
    fields = [*SCHEMAS[table].fields, T.StructField(_LINE, T.StringType())]
    fields += [T.StructField(_REASONS, T.ArrayType(T.StringType())), T.StructField("rejected", T.BooleanType())]
    return spark.read.schema(T.StructType(fields)).parquet(into)


def accepted(spark: SparkSession, into: str, table: str) -> DataFrame:
    """The rows that fit, with the table's columns; only their files are read."""
    return _stored(spark, into, table).where("NOT rejected").select(*SCHEMAS[table].fieldNames())


def rejected(spark: SparkSession, into: str, table: str) -> DataFrame:
    """The table's columns as far as they parsed, ``reasons``, and ``line``, the text of a row that
    did not parse."""
    names = SCHEMAS[table].fieldNames()
    rows = _stored(spark, into, table).where("rejected")
    return rows.select(*names, F.col(_REASONS).alias("reasons"), F.col(_LINE).alias("line"))


def reject_counts(spark: SparkSession, into: str, table: str) -> DataFrame:
    """``reason, n``: rows per reason, a row once for each of its reasons, and ``accepted``."""
    rows = _stored(spark, into, table)
    reason = F.expr(f"explode(IF(rejected, {_REASONS}, array('accepted'))) AS reason")
    return rows.select(reason).groupBy("reason").agg(F.count("*").alias("n"))

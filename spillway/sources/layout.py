"""A layout for filters on either of several keys: bit-interleaved order, and bloom filters.

A table sorted by one key helps filters on that key alone.  Here every row gets a place on a curve
that takes turns between the keys' binary digits; files and row groups then hold small boxes of the
key space, and their statistics rule most of them out for a filter on any of the keys.  Spark hands
no filter on times without zone to Parquet, so a time has to come with a column of its day, and filters
on the time with one on the day.  Columns that no order helps (references, hashes) get Parquet bloom filters, for lookups of single values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions import columns


def interleaved(coordinates: Sequence[str], digits: int) -> str:
    """SQL for the long whose binary digits are those of the ``coordinates`` in turn.

    ``coordinates`` are SQL longs from 0 up to ``2 ** digits``, exclusive; the first one's digits
    are the lowest of each turn.
    """
    if digits * len(coordinates) > 62:
        raise ValueError("the digits of all coordinates together have to fit a long")
    parts = [
        f"shiftleft({value} & {1 << digit}L, {digit * (len(coordinates) - 1) + turn})"
        for digit in range(digits)
        for turn, value in enumerate(coordinates)
    ]
    return " | ".join(parts)


def write_interleaved(
    frame: DataFrame,
    path: str,
    keys: Mapping[str, str],
    spread: Sequence[str] = (),
    files: int | None = None,
    lookups: Mapping[str, int] | None = None,
    digits: int = 16,
    options: Mapping[str, str] | None = None,
) -> None:
    """Replace the table at ``path`` by ``frame``, clustered by all ``keys`` alike.

    ``keys`` maps a column to an SQL whole number that orders it (the column itself, or the number of
    a day).  Coordinates are linear between the smallest and the greatest value, which one
    aggregate finds; NULL counts as the smallest.  A key with few frequent values is clustered less
    finely, but rows that share one value are still spread by the other keys, and rows that share
    all of them by the columns ``spread``.  ``files`` is the number of ranges the rows are dealt in,
    by default the session's shuffle partitions; ``lookups`` gives columns with bloom filters and
    about how many distinct values a row group has of each; ``options`` go to the Parquet writer.
    """
    ends = frame.agg(
        *columns(f"{end}(CAST({value} AS BIGINT)) AS {end}_{n}" for n, value in enumerate(keys.values()) for end in ("min", "max"))
    ).first()
    top = (1 << digits) - 1
    coordinates, places = [], []
    for n, value in enumerate(keys.values()):
        low, high = ends[f"min_{n}"] or 0, ends[f"max_{n}"] or 0
        # In doubles: the product could pass a long, and a place on the curve is no result.
        place = f"floor((CAST(CAST({value} AS BIGINT) AS DOUBLE) - {low}) / {max(1, high - low)} * {top})"
        places.append(f"least({top}L, greatest(0L, coalesce(CAST({place} AS BIGINT), 0L))) AS _place_{n}")
        coordinates.append(f"_place_{n}")
    drawn = frame.selectExpr("*", *places).selectExpr("*", f"{interleaved(coordinates, digits)} AS _curve")
    order = ["_curve", *spread]
    dealt = drawn.repartitionByRange(files, *order) if files else drawn.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).select(*frame.columns).write.mode("overwrite")
    for column, distinct in (lookups or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
    writer.options(**(options or {})).parquet(path)


def rows_scanned(frame: DataFrame) -> int:
    """Runs ``frame``, a selection over files, and says how many rows its scans gave after files and
    row groups were ruled out.  A measure for layouts, from Spark's own figures."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(n).metrics().apply("numOutputRows").value() for n in range(leaves.size()))

"""Ranks and exact percentiles of whole tables, without one task that sees all rows.

Ranks come from a range split: rows are counted per value, the values dealt in ranges, and a rank
is the number of rows in the ranges before, plus those before it in its own range.  Equal values
are one row of the counts, so ties never lie across a border, however many rows share them.

Percentiles come from narrowing histograms: a pass counts rows by the next few binary digits of
their value, finds the bucket in which the wanted place lies, and the next pass only looks inside
it.  What is held per group is one histogram, whatever the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns, name

#: Binary digits a pass of :func:`exact_percentiles` looks at: buckets of a group's histogram.
_DIGITS = 12


def ranked(rows: DataFrame, value: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """``rows`` with their rank by the SQL ``value``, as ``rank() OVER (ORDER BY value DESC)``.

    Equal values share a rank and leave a gap; NULL comes last, in either direction.  The counts per
    value are written once, so that every step sees the same ranges.
    """
    # Opened here and not above: tables know their rules by this package's operators.
    from ..sources.scratch import shared_folder

    spark = rows.sparkSession
    order = F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_last()
    keyed = rows.withColumn("_value", F.expr(value))
    place = shared_folder(spark, "ranks")
    (
        keyed.groupBy("_value")
        .agg(F.count("*").alias("_n"))
        .repartitionByRange(order)
        .withColumn("_part", F.spark_partition_id())
        .write.parquet(place)
    )
    counts = spark.read.parquet(place)
    # One row per range: the only window without a partition.
    parts = (
        counts.groupBy("_part")
        .agg(F.sum("_n").alias("_rows"))
        .selectExpr("_part", "sum(_rows) OVER (ORDER BY _part) - _rows AS _before")
    )
    direction = "DESC" if descending else "ASC"
    places = (
        counts.selectExpr(
            "*", f"sum(_n) OVER (PARTITION BY _part ORDER BY _value {direction} NULLS LAST) - _n AS _inside"
        )
        .join(parts, "_part")
        .selectExpr("_value AS _ranked", f"_before + _inside + 1 AS {name(out)}")
    )
    found = keyed.join(places, keyed["_value"].eqNullSafe(places["_ranked"]))
    return found.drop("_value", "_ranked")


def exact_percentiles(
    rows: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float] = (0.5,)
) -> DataFrame:
    """``by..., fraction, n, percentile``: exact percentiles of the whole-number SQL ``value`` in each
    group, interpolated between neighbours as ``percentile`` does.

    ``value`` is a BIGINT, such as an amount in the smallest unit or a time in seconds; rows without
    one do not count, and a group without any has no row.  The values of the table may span at most
    62 binary digits.  Groups whose key is NULL are groups.  The table is read once per twelve binary
    digits of the values' span, and once for the sizes.
    """
    from ..sources.scratch import shared_folder

    spark = rows.sparkSession
    keys = [f"_k{i}" for i in range(len(by))]
    values = rows.selectExpr(*[f"{b} AS {k}" for b, k in zip(by, keys)], f"CAST({value} AS BIGINT) AS _v").where("_v IS NOT NULL")

    def kept(frame: DataFrame) -> DataFrame:
        place = shared_folder(spark, "percentiles")
        frame.write.parquet(place)
        return spark.read.schema(frame.schema).parquet(place)

    sizes = kept(values.groupBy(*keys).agg(*columns(["count(1) AS _n", "min(_v) AS _low", "max(_v) AS _high"])))
    low, high = sizes.agg(F.min("_low"), F.max("_high")).first()
    if low is None:
        low = high = 0
    digits = max(1, (high - low).bit_length())
    if digits > 62:
        raise ValueError("the values span more than 62 binary digits")
    offsets = values.selectExpr(*keys, f"_v - ({low}L) AS _v")
    wanted = ", ".join(f"{float(f)!r}D" for f in fractions)
    # Both neighbours of each wanted place, as 0-based ranks; ``_inside`` counts from its bucket.
    targets = kept(
        sizes.selectExpr(*keys, "_n", f"explode(array({wanted})) AS _fraction")
        .selectExpr("*", "(_n - 1) * _fraction AS _at")
        .selectExpr(*keys, "_n", "_fraction", "_at", "explode(array(floor(_at), ceil(_at))) AS _rank")
        .distinct()
        .selectExpr("*", "_rank AS _inside", "0L AS _prefix")
    )
    shift = digits
    while shift > 0:
        step = min(_DIGITS, shift)
        before, shift = shift, shift - step
        places = offsets.selectExpr(*keys, f"shiftright(_v, {before}) AS _prefix", f"shiftright(_v, {shift}) AS _next")
        inside = _equal(places, targets.select(*keys, "_prefix").distinct(), [*keys, "_prefix"], "left_semi")
        histogram = inside.groupBy(*keys, "_prefix", "_next").agg(*columns(["count(1) AS _count"]))
        group = ", ".join([*keys, "_prefix"])
        until = f"sum(_count) OVER (PARTITION BY {group} ORDER BY _next)"
        histogram = histogram.selectExpr("*", f"{until} AS _until")
        found = _equal(targets, histogram, [*keys, "_prefix"], "inner")
        targets = kept(
            found.where("_inside >= _until - _count AND _inside < _until").selectExpr(
                *keys, "_n", "_fraction", "_at", "_rank", "_inside - (_until - _count) AS _inside", "_next AS _prefix"
            )
        )
    return targets.groupBy(*keys, "_fraction").agg(
        *columns(
            [
                "max(_n) AS n",
                f"""CAST(min(_prefix) + ({low}L) AS DOUBLE)
                    + (max(_prefix) - min(_prefix)) * (max(_at) - floor(max(_at))) AS percentile""",
            ]
        )
    ).selectExpr(*[f"{k} AS {b}" for b, k in zip(by, keys)], "_fraction AS fraction", "n", "percentile")


def _equal(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join in which NULL keys are equal; the right side's keys are left out."""
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in on})
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return left.join(renamed, same, how).drop(*[f"_r{k}" for k in on])

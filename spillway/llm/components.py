"""Connected components of a link table too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``; a component is its smallest node.

    Every node points to the smallest label among its neighbours, its former root learns that label
    too, and pointers are then shortened by half, so the number of rounds grows with the logarithm
    of the longest path.  Labels and links are stored between steps: a node with very many links is
    one skewed key of a plain join of two tables, which adaptive execution splits.  Nulls and links
    of a node with itself are dropped; repeated links change nothing.
    """
    ends = links.where("a < b OR a > b").selectExpr(
        "inline(array(named_struct('node', a, 'other', b), named_struct('node', b, 'other', a)))"
    )
    both = stored(ends.distinct(), f"{purpose}-links")
    labels = stored(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")),
        f"{purpose}-labels",
    )
    before = None
    while (now := _signature(labels)) != before:
        before, labels = now, _round(both, labels, purpose)
    return labels.withColumnRenamed("label", "component")


def _signature(labels: DataFrame) -> tuple:
    return tuple(labels.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "label"))).first())


def _round(both: DataFrame, labels: DataFrame, purpose: str) -> DataFrame:
    heard = both.join(labels.withColumnRenamed("node", "other"), "other").selectExpr(
        "node", "label", "CAST(NULL AS BIGINT) AS root"
    )
    least = (
        heard.union(labels.selectExpr("node", "label", "label AS root"))
        .groupBy("node")
        .agg(F.min("label").alias("label"), F.max("root").alias("root"))
    )
    hooked = stored(
        least.selectExpr("inline(array(struct(node, label), struct(root AS node, label)))")
        .groupBy("node")
        .agg(F.min("label").alias("label")),
        f"{purpose}-hooked",
    )
    above = hooked.toDF("label", "higher")
    return stored(
        hooked.join(above, "label").selectExpr("node", "higher AS label"), f"{purpose}-labels"
    )

"""Mixing sources to target weights, with DataFrame and SQL functions only.

A corpus is a tree, such as domain, language, source.  The token budget flows from the root down by
the weights of the nodes.  A node that cannot use its share (its documents times the most epochs are
fewer tokens) takes all it can, and its siblings share the rest by their weights; only what no
sibling can use goes to the siblings of the parent.  Both follow from one rule, applied from the top
with every node's capacity known: raise the water level until the budget is used up, and let full
nodes be full.

Each leaf then takes its budget from seeded epochs: whole passes over its documents while they fit,
and of the next pass, whose order is a seeded hash, the documents that begin inside the budget.  The
order is never laid out for a whole leaf.  Token sums per hash prefix show the one prefix in which
the budget ends, and only the documents of that prefix are sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small, stored

#: Words, as tokens are counted where no other expression is given.
WORDS = r"coalesce(regexp_count({text}, '[^\\x20\\x09-\\x0D]+'), 0)"


@dataclass(frozen=True)
class Mix:
    """``levels``: name and SQL expression of each level of the tree, the leaves' last.  ``weights``:
    by level and value, 1 where nothing is said, 0 for nothing.  ``share``: the budget as a share of
    all tokens.  ``epochs``: the most passes over a document.  ``tokens``: SQL for a document's."""

    levels: tuple[tuple[str, str], ...]
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    share: float = 1.0
    epochs: int = 1
    seed: int = 42
    tokens: str = WORDS.format(text="text")
    doc_id: str = "doc_id"


def _names(mix: Mix) -> list[str]:
    return [f"_mix_{name}" for name, _ in mix.levels]


def _weight(mix: Mix, level: int) -> str:
    """SQL for the weight of a node of a level."""
    name = mix.levels[level][0]
    cases = "".join(
        f" WHEN '{value}' THEN {float(w)}D" for value, w in mix.weights.get(name, {}).items()
    )
    return f"CASE _mix_{name}{cases} ELSE 1.0D END" if cases else "1.0D"


def _leaves(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with their place in the tree and ``_mix_tokens``; a null is a value of its own."""
    places = {
        name: F.expr(f"coalesce(CAST({sql} AS STRING), '(none)')")
        for name, (_, sql) in zip(_names(mix), mix.levels)
    }
    return docs.withColumns({**places, "_mix_tokens": F.expr(f"CAST({mix.tokens} AS BIGINT)")})


def _key(mix: Mix) -> str:
    """SQL for the place of a document in the order of the epoch its leaf ends in."""
    text = f"coalesce(CAST({mix.doc_id} AS STRING), '')"
    return f"md5(CAST(concat('{mix.seed}:', CAST(_mix_full AS STRING), ':', {text}) AS BINARY))"


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``[levels], supply, budget`` for ``leaves ([levels], supply)``: whole tokens per leaf."""
    names = _names(mix)
    used = " AND ".join(f"{_weight(mix, level)} > 0" for level in range(len(names)))
    nodes = leaves.withColumn("_cap", F.expr(f"IF({used}, supply * {mix.epochs}, 0)"))
    everything, capacity = nodes.agg(F.sum("supply"), F.sum("_cap")).first()
    whole = min((everything or 0) * float(mix.share), float(capacity or 0))
    parents = None
    for level in range(len(names)):
        path = names[: level + 1]
        children = nodes.groupBy(*path).agg(F.sum("_cap").alias("_cap"))
        joined = children.join(parents, names[:level]) if level else children.withColumn("_budget", F.lit(whole))
        parents = _filled(joined, names[:level], names[level], _weight(mix, level)).select(*path, "_budget")
    return leaves.join(parents, names).withColumn(
        "budget", F.expr("CAST(floor(_budget + 1e-6D) AS BIGINT)")
    ).drop("_budget")


def _filled(nodes: DataFrame, parent: list[str], name: str, weight: str) -> DataFrame:
    """Siblings with ``_budget`` (their parent's) replaced by their own.

    Sorted by capacity per weight, the full siblings come first; the first one that is not full
    shows the water level.  Siblings are the nodes below one parent, never documents.
    """
    among = f"PARTITION BY {', '.join(parent) or '1'}"
    order = f"{among} ORDER BY _ratio, {name}"
    return (
        nodes.selectExpr("*", f"{weight} AS _weight")
        .selectExpr("*", "IF(_cap = 0, 0D, _cap / _weight) AS _ratio")
        .selectExpr(
            "*",
            f"row_number() OVER ({order}) AS _place",
            f"sum(_cap) OVER ({order} ROWS UNBOUNDED PRECEDING) - _cap AS _before",
            f"sum(_weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _left",
        )
        .selectExpr("*", "try_divide(_budget - _before, _left) AS _level")
        .selectExpr(
            "*",
            f"min(IF(_ratio > _level, struct(_place, _level), NULL)) OVER ({among}) AS _open",
        )
        .selectExpr(
            *parent,
            name,
            """IF(_open IS NULL OR _place < _open._place, CAST(_cap AS DOUBLE),
                _weight * _open._level) AS _budget""",
        )
    )


def mix_plan(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf: ``[levels], supply, budget, _mix_full, _mix_last``: its whole epochs, and
    the last key taken from the epoch after them (null: none)."""
    names = _names(mix)
    slim = stored(_leaves(docs, mix).select(*names, "_mix_tokens", mix.doc_id), "mix-documents")
    leaves = slim.groupBy(*names).agg(F.sum("_mix_tokens").alias("supply"), F.count("*").alias("documents"))
    leaves = stored(leaves, "mix-leaves")
    plan = stored(
        budgets(leaves.drop("documents"), mix)
        .withColumn("_mix_full", F.expr("IF(supply = 0, 0L, budget DIV supply)"))
        .withColumn("_mix_rest", F.expr("budget - _mix_full * supply")),
        "mix-budgets",
    )
    total = leaves.agg(F.sum("documents")).first()[0] or 0
    digits = max(1, math.ceil(math.log(total + 1, 16) / 2))
    ended = small(plan.where("_mix_rest > 0").select(*names, "_mix_full", "_mix_rest"))
    keyed = slim.join(ended, names).withColumn("_key", F.expr(_key(mix)))
    prefix = F.substring("_key", 1, digits).alias("_prefix")
    leaf = ", ".join(names)
    cells = keyed.groupBy(*names, "_mix_rest", prefix).agg(F.sum("_mix_tokens").alias("_sum"))
    ends = stored(
        cells.selectExpr("*", f"sum(_sum) OVER (PARTITION BY {leaf} ORDER BY _prefix) - _sum AS _before")
        .where("_before < _mix_rest AND _mix_rest <= _before + _sum")
        .select(*names, "_prefix", "_before"),
        "mix-ends",
    )
    last = (
        keyed.withColumn("_prefix", prefix)
        .join(small(ends), [*names, "_prefix"])
        .groupBy(*names, "_mix_rest", "_before", "_key")
        .agg(F.sum("_mix_tokens").alias("_sum"))
        .selectExpr("*", f"_before + sum(_sum) OVER (PARTITION BY {leaf} ORDER BY _key) - _sum AS _begin")
        .where("_begin < _mix_rest")
        .groupBy(*names)
        .agg(F.max("_key").alias("_mix_last"))
    )
    return stored(plan.join(last, names, "left").drop("_mix_rest"), "mix-plan")


def mixed(docs: DataFrame, mix: Mix, epoch: str = "epoch") -> DataFrame:
    """The documents taken, with all their columns and ``epoch`` (from 0; a column of that name is
    replaced), once for each epoch they are taken in.

    The documents of an epoch that a leaf does not finish are those that begin before its budget
    ends, so a leaf goes over its budget by less than the tokens of one id: one document where ids
    are unique.  Rows that repeat an id, and all rows with a null (or empty) id, have one place in the
    order and are taken or left together, so a leaf can pass its budget by up to all their tokens in
    it.  Nulls in a level are a value of their own;
    a null text has no tokens and is taken if its place is before the end; a leaf without tokens has
    no budget and gives nothing; an empty table gives an empty one.
    """
    names = _names(mix)
    plan = mix_plan(docs, mix).drop("supply", "budget")
    rows = _leaves(docs.drop(epoch), mix).join(small(plan), names)
    partial = f"IF({_key(mix)} <= _mix_last, _mix_full + 1, _mix_full)"
    taken = rows.withColumn("_mix_times", F.expr(f"CAST(coalesce({partial}, _mix_full) AS INT)"))
    own = [c for c in docs.columns if c != epoch]
    return taken.where("_mix_times > 0").select(
        *own, F.explode(F.expr("sequence(0, _mix_times - 1)")).alias(epoch)
    )

"""Entities that never finished: where they stopped, for how long, and what they are worth."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions import StageLog, by_merge, columns, days_between, mean_of, name
from .progress import furthest_stage


def stuck_report(log: StageLog, facts: DataFrame, amount: str, as_of: dt.date) -> DataFrame:
    """``stage_order, stage, entities, avg_days_inactive, avg_amount, total_amount`` for entities
    whose furthest stage is not the ladder's last."""
    stopped = furthest_stage(log).where(f"stage_order < {len(log.ladder.stages)}")
    idle, value = days_between("last_activity", f"DATE '{as_of}'"), name(amount)
    return (
        stopped.join(by_merge(facts.select(log.entity, amount)), log.entity)
        .groupBy("stage_order")
        .agg(
            *columns(
                [
                    "count(1) AS entities",
                    f"{mean_of(f'sum({idle})', f'count({idle})', 0)} AS avg_days_inactive",
                    f"{mean_of(f'sum({value})', f'count({value})', 0)} AS avg_amount",
                    f"CAST(sum({value}) AS BIGINT) AS total_amount",
                ]
            )
        )
        .selectExpr("*", f"{log.ladder.name_at('stage_order')} AS stage")
    )

"""Stage ladders and stage logs: the two parameters every funnel operator takes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .scalars import name, text


@dataclass(frozen=True)
class StageLadder:
    """Stage names in funnel order (at most 62, so that a set of stages fits one long)."""

    stages: tuple[str, ...]

    def __post_init__(self):
        if not 0 < len(self.stages) <= 62:
            raise ValueError("a ladder has 1 to 62 stages")
        if len(set(self.stages)) != len(self.stages):
            raise ValueError("stage names must differ")

    @property
    def first(self) -> str:
        return self.stages[0]

    @property
    def last(self) -> str:
        return self.stages[-1]

    def index(self, stage: str) -> int:
        return self.stages.index(stage)

    def holds(self, stage: str, *names: str) -> str:
        """SQL test: is ``stage`` on the ladder, or one of ``names``?"""
        return f"{stage} IN ({', '.join(text(s) for s in names or self.stages)})"

    def order(self, stage: str) -> str:
        """SQL for the 1-based position of a stage; NULL for a name that is not on the ladder."""
        return self._map(stage, range(1, len(self.stages) + 1))

    def bit(self, stage: str) -> str:
        """SQL for a long with the stage's bit set; OR-ing them gives the set of stages reached."""
        return self._map(stage, (f"{1 << i}L" for i in range(len(self.stages))))

    def reached(self, stage_set: str, stage: str) -> str:
        """SQL for 0/1: is ``stage`` in a stage set?"""
        return f"CAST(getbit({stage_set}, {self.index(stage)}) AS INT)"

    def includes(self, stage_set: str, *names: str) -> str:
        """SQL test: are all ``names`` in a stage set?"""
        wanted = sum(1 << self.index(s) for s in names)
        return f"({stage_set} & {wanted}L) = {wanted}L"

    def name_at(self, order: str) -> str:
        """SQL inverse of :meth:`order`."""
        cases = " ".join(f"WHEN {i} THEN {text(s)}" for i, s in enumerate(self.stages, 1))
        return f"CASE {order} {cases} END"

    def _map(self, stage, values):
        cases = " ".join(f"WHEN {text(s)} THEN {v}" for s, v in zip(self.stages, values))
        return f"CASE {stage} {cases} END"


@dataclass(frozen=True)
class StageLog:
    """An event log seen through a ladder.

    Rows whose stage is not on the ladder are ignored by every operator (the constraint report
    counts them), so a stray stage name can never become the top of the funnel.
    """

    events: DataFrame
    ladder: StageLadder
    entity: str = "application_id"
    stage: str = "stage"
    at: str = "event_timestamp"

    @property
    def stage_sql(self) -> str:
        return name(self.stage)

    @property
    def at_sql(self) -> str:
        return name(self.at)

    def rows(self, *stages: str) -> DataFrame:
        """Ladder rows only, or only those of the named stages."""
        return self.events.where(self.ladder.holds(self.stage_sql, *stages))

    def where(self, condition: str) -> StageLog:
        return replace(self, events=self.events.where(condition))


# The loan funnel, in order.
LOAN_LADDER = StageLadder(("submitted", "under_review", "verified", "approved", "disbursed"))

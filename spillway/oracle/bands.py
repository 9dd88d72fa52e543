"""The band ladders of the statements, each defined once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ladder:
    """(condition, label) in the order reports print them; ``{v}`` is the value."""

    cases: tuple[tuple[str, str], ...]
    otherwise: str | None = None

    def label(self, value: str) -> str:
        results = [f"'{label}'" for _, label in self.cases]
        return self._case(value, results, f"'{self.otherwise}'")

    def place(self, value: str) -> str:
        results = [str(n) for n in range(1, len(self.cases) + 2)]
        return self._case(value, results, results[-1])

    def _case(self, value: str, results: list[str], last: str) -> str:
        cases = " ".join(
            f"WHEN {condition.format(v=value)} THEN {result}"
            for (condition, _), result in zip(self.cases, results)
        )
        return f"CASE {cases}{'' if self.otherwise is None else f' ELSE {last}'} END"


# Band limits and labels.
AGES = Ladder(
    (
        ("{v} BETWEEN 18 AND 25", "18–25"),
        ("{v} BETWEEN 26 AND 35", "26–35"),
        ("{v} BETWEEN 36 AND 45", "36–45"),
        ("{v} BETWEEN 46 AND 55", "46–55"),
        ("{v} >= 56", "56+"),
    )
)
CREDIT = Ladder(
    (
        ("{v} >= 750", "750–850  Excellent"),
        ("{v} >= 700", "700–749  Good"),
        ("{v} >= 650", "650–699  Fair"),
        ("{v} >= 600", "600–649  Poor"),
        ("{v} < 600", "300–599  Very Poor"),
    )
)
JOURNEYS = Ladder(
    (
        ("{v} <= 7", "Fast    (≤7 days)"),
        ("{v} <= 14", "Average (8–14 days)"),
        ("{v} <= 21", "Slow    (15–21 days)"),
    ),
    "Very slow (>21 days)",
)
RESPONSES = Ladder(
    (
        ("{v} <= 6", "1. Same day     (≤6 hrs)"),
        ("{v} <= 24", "2. Next day     (7–24 hrs)"),
        ("{v} <= 48", "3. Two days     (25–48 hrs)"),
    ),
    "4. Slow         (>48 hrs)",
)

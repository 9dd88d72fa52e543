"""Ordered value bands: the CASE ladders that turn a number into a labelled tier."""

from __future__ import annotations

from dataclasses import dataclass

from .scalars import text


@dataclass(frozen=True)
class Band:
    """Inclusive range; an open end is ``None``."""

    label: str
    low: int | None = None
    high: int | None = None

    def holds(self, value: str) -> str:
        bounds = []
        if self.low is not None:
            bounds.append(f"{value} >= {self.low}")
        if self.high is not None:
            bounds.append(f"{value} <= {self.high}")
        return " AND ".join(bounds)


@dataclass(frozen=True)
class Bands:
    """Bands tried in order.  ``otherwise`` labels what no band holds, NULL values included."""

    bands: tuple[Band, ...]
    otherwise: str | None = None

    def label(self, value: str) -> str:
        """SQL for the label of ``value``."""
        default = None if self.otherwise is None else text(self.otherwise)
        return self._pick(value, [text(b.label) for b in self.bands], default)

    def position(self, value: str) -> str:
        """SQL for the 1-based rank of the band, for sorting a report in band order."""
        ranks = [str(i) for i in range(1, len(self.bands) + 2)]
        return self._pick(value, ranks, None if self.otherwise is None else ranks[-1])

    def _pick(self, value, results, default):
        cases = " ".join(f"WHEN {b.holds(value)} THEN {r}" for b, r in zip(self.bands, results))
        return f"CASE {cases}{'' if default is None else f' ELSE {default}'} END"


# Band limits and labels as reports print them (en dash, <= sign, aligned blanks).
AGE_GROUPS = Bands(
    (
        Band("18–25", 18, 25),
        Band("26–35", 26, 35),
        Band("36–45", 36, 45),
        Band("46–55", 46, 55),
        Band("56+", 56, None),
    )
)
CREDIT_BANDS = Bands(
    (
        Band("750–850  Excellent", 750, None),
        Band("700–749  Good", 700, 749),
        Band("650–699  Fair", 650, 699),
        Band("600–649  Poor", 600, 649),
        Band("300–599  Very Poor", None, 599),
    )
)
JOURNEY_SPEEDS = Bands(
    (
        Band("Fast    (≤7 days)", None, 7),
        Band("Average (8–14 days)", None, 14),
        Band("Slow    (15–21 days)", None, 21),
    ),
    otherwise="Very slow (>21 days)",
)
RESPONSE_TIERS = Bands(
    (
        Band("1. Same day     (≤6 hrs)", None, 6),
        Band("2. Next day     (7–24 hrs)", None, 24),
        Band("3. Two days     (25–48 hrs)", None, 48),
    ),
    otherwise="4. Slow         (>48 hrs)",
)

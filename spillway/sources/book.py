"""The loan book: the four tables every named report reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ..functions import LOAN_LADDER, StageLog

TABLES = ("applicants", "loan_applications", "application_events", "credit_profiles")


class LoanBook:
    """Four tables, each a DataFrame or a function that opens it when a report first needs it."""

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        if set(tables) != set(TABLES):
            raise ValueError(f"a loan book has the tables {', '.join(TABLES)}")
        self._tables = dict(tables)

    def table(self, name: str) -> DataFrame:
        frame = self._tables[name]
        if not isinstance(frame, DataFrame):
            frame = self._tables[name] = frame()
        return frame

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    @property
    def applicants(self) -> DataFrame:
        return self.table("applicants")

    @property
    def loan_applications(self) -> DataFrame:
        return self.table("loan_applications")

    @property
    def application_events(self) -> DataFrame:
        return self.table("application_events")

    @property
    def credit_profiles(self) -> DataFrame:
        return self.table("credit_profiles")

    @property
    def log(self) -> StageLog:
        return StageLog(self.application_events, LOAN_LADDER)

    def create_views(self) -> None:
        """Name the tables for ``spark.sql``; existing views of these names are replaced."""
        for name, frame in self.tables().items():
            frame.createOrReplaceTempView(name)

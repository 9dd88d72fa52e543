"""Funnel analytics over staged event logs, as Spark DataFrames."""

from .functions import LOAN_LADDER, Band, Bands, StageLadder, StageLog
from .sources import LoanBook

__all__ = ["LOAN_LADDER", "Band", "Bands", "LoanBook", "StageLadder", "StageLog"]

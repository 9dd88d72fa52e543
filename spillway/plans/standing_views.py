"""The views kept up to date load by load, without reading the log again.

Two tables on disk, both partitioned by the day of application: one row per application with the
set of its stages and the times that count, and additive tallies per day, product and channel.  A
load is reduced to its own applications and merged into the days it touches, the tallies of those
days are taken anew from their applications, and a view adds up tallies.  Stage sets, first and last
times and the newest application row do not depend on order or repeats, so loads may come late, in
any order, and twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import LOAN_LADDER, StageLog, by_merge, columns, days_between
from ..operators import entity_progress, reached
from ..operators.segments import TOTAL
from ..sources.partitions import merge, overwrite_partitions, read_partitions
from ..sources.scratch import remove_folder, shared_folder
from .dashboard import dashboard_figures
from .segment_reports import channel_figures, segment_figures

_PROGRESS = """application_id BIGINT, stage_set BIGINT, first_submitted TIMESTAMP_NTZ,
    last_disbursed TIMESTAMP_NTZ, facts STRUCT<load: BIGINT, applied_on: DATE, loan_type: STRING,
    loan_amount: BIGINT, person: BOOLEAN, channel: STRING>, applied_on DATE"""

_BY = ["on_book", "loan_type", "person", "channel"]
_ADDITIVE = {
    TOTAL: "1L",
    **{s: reached(StageLog(None, LOAN_LADDER), s) for s in LOAN_LADDER.stages},
    "amount": "loan_amount",
    "amount_known": "IF(loan_amount IS NULL, 0, 1)",
    "paid_out": "IF({disbursed} = 1, loan_amount, 0)",
    "at_risk": "IF({disbursed} = 1, 0, loan_amount)",
    "days": days_between("first_submitted", "last_disbursed"),
    "days_known": "IF(first_submitted IS NULL OR last_disbursed IS NULL, 0, 1)",
}


class StandingViews:
    """The two tables in a folder, and the views over them.

    ``period`` is what a partition holds: the applications of a ``day``, or of a ``month`` where days
    are small.
    """

    def __init__(self, spark: SparkSession, folder: str, period: str = "day"):
        self.spark, self.folder, self.period = spark, folder, period

    def load(
        self,
        number: int,
        events: DataFrame | None = None,
        applications: DataFrame | None = None,
        applicants: DataFrame | None = None,
    ) -> list:
        """Merge new events and new or corrected applications; returns the days it touched.

        Of several rows of one application the one from the load with the greatest ``number`` counts.
        ``applicants`` has to hold the applicants of the applications given.  Events may come before
        their application; until then they count as in the views over the log, without a day.
        """
        delta = self._reduced(number, events, applications, applicants)
        days = merge(delta, f"{self.folder}/progress", "applied_on", ["application_id"], _combined)
        if days:
            self._tally(days)
        return days

    def _reduced(self, number, events, applications, applicants) -> DataFrame:
        parts, day = [], f"CAST(date_trunc('{self.period}', application_date) AS DATE)"
        if events is not None:
            log = StageLog(events, LOAN_LADDER)
            parts.append(
                entity_progress(log, first_of=["submitted"], last_of=["disbursed"])
                .where("application_id IS NOT NULL")
                .selectExpr(
                    "application_id", "stage_set", "first_submitted", "last_disbursed",
                    "NULL AS facts", "CAST(NULL AS DATE) AS applied_on",
                )
            )
        if applications is not None:
            people = applicants.selectExpr("applicant_id", "acquisition_channel AS channel", "true AS person")
            parts.append(
                applications.join(by_merge(people), "applicant_id", "left").selectExpr(
                    "application_id", "CAST(NULL AS BIGINT) AS stage_set",
                    "CAST(NULL AS TIMESTAMP_NTZ) AS first_submitted", "CAST(NULL AS TIMESTAMP_NTZ) AS last_disbursed",
                    f"""struct({number}L AS load, {day} AS applied_on, loan_type,
                        loan_amount, coalesce(person, false) AS person, channel) AS facts""",
                    f"{day} AS applied_on",
                )
            )
        typed = [p.to(self.spark.createDataFrame([], _PROGRESS).schema) for p in parts]
        rows = typed[0] if len(typed) == 1 else typed[0].unionByName(typed[1])
        return _combined(rows)

    def _progress(self) -> DataFrame:
        return read_partitions(self.spark, f"{self.folder}/progress", self.spark.createDataFrame([], _PROGRESS))

    def _tally(self, days: list) -> None:
        """Take the touched days' tallies anew; a day that lost all its applications gets none."""
        wanted = self.spark.createDataFrame([(d,) for d in days], "applied_on DATE")
        known = [d for d in days if d is not None]
        progress = self._progress()
        pruned = progress.applied_on.isin(known) | progress.applied_on.isNull() if known else progress.applied_on.isNull()
        rows = progress.where(pruned).where("stage_set IS NOT NULL")
        tallies = _tallied(rows)
        empty = wanted.join(tallies.select("applied_on").distinct(), wanted.applied_on.eqNullSafe(tallies.applied_on), "left_anti")
        blank = empty.selectExpr(
            "applied_on", *[f"CAST(NULL AS {tallies.schema[c].dataType.simpleString()}) AS {c}" for c in (*_BY, *_ADDITIVE)]
        )
        place = shared_folder(self.spark, "tallies")
        tallies.unionByName(blank).write.parquet(place)
        staged = self.spark.read.schema(tallies.schema).parquet(place)
        overwrite_partitions(staged, f"{self.folder}/tallies", "applied_on")
        remove_folder(self.spark, place)

    def tallies(self) -> DataFrame:
        """Additive figures per day, product and channel; one row per combination that occurs."""
        like = _tallied(self._progress().limit(0))
        return read_partitions(self.spark, f"{self.folder}/tallies", like).where(f"{TOTAL} IS NOT NULL")

    def _added(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*columns(f"sum({m}) AS {m}" for m in _ADDITIVE))

    def channel_performance(self) -> DataFrame:
        people = self.tallies().where("on_book AND person")
        return channel_figures(self._added(people.withColumnRenamed("channel", "acquisition_channel"), ["acquisition_channel"]))

    def segment_conversion(self) -> DataFrame:
        return segment_figures(self._added(self.tallies().where("on_book"), ["loan_type"]))

    def executive_dashboard(self) -> DataFrame:
        on_book = "sum({0}) FILTER (WHERE on_book) AS {0}"
        every = [f"coalesce(sum({m}), 0L) AS {m}" for m in ("submitted", "disbursed")]
        every += ["sum(days) AS days", "sum(days_known) AS days_known"]
        return dashboard_figures(
            self.tallies().agg(*columns([*every, on_book.format("paid_out"), on_book.format("at_risk")]))
        )


def _combined(rows: DataFrame) -> DataFrame:
    """One row per application; indifferent to order and repeats."""
    return (
        rows.groupBy("application_id")
        .agg(
            *columns(
                [
                    "bit_or(stage_set) AS stage_set",
                    "min(first_submitted) AS first_submitted",
                    "max(last_disbursed) AS last_disbursed",
                    "max(facts) AS facts",
                ]
            )
        )
        .selectExpr("*", "facts.applied_on AS applied_on")
    )


def _tallied(progress: DataFrame) -> DataFrame:
    disbursed = _ADDITIVE[LOAN_LADDER.last]
    facts = progress.selectExpr(
        "*", "facts IS NOT NULL AS on_book", "facts.loan_type", "facts.loan_amount", "coalesce(facts.person, false) AS person", "facts.channel"
    )
    sums = [f"CAST(sum({value.format(disbursed=disbursed)}) AS BIGINT) AS {m}" for m, value in _ADDITIVE.items()]
    return facts.groupBy("applied_on", *_BY).agg(*columns(sums)).select("applied_on", *_BY, *_ADDITIVE)

"""The five named views and the one-row executive snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import by_merge, columns, days_between, mean_of, percent
from ..operators import entity_progress, reached
from ..sources import LoanBook
from .funnel_reports import funnel_overview, stage_dropoff
from .segment_reports import channel_performance, segment_performance


def funnel_kpi_summary(book: LoanBook) -> DataFrame:
    return funnel_overview(book, drop_name="dropped_at_stage")


def executive_dashboard(book: LoanBook) -> DataFrame:
    """Volume, conversion, speed and value in one row.

    Everything is a sum over one row per application, so one pass over the events, one join and
    one global aggregate give all eight figures.
    """
    log = book.log
    start, end = log.ladder.first, log.ladder.last
    amounts = book.loan_applications.selectExpr("application_id", "loan_amount", "true AS on_book")
    paid = f"{reached(log, end)} = 1"
    days = days_between(f"first_{start}", f"last_{end}")
    return dashboard_figures(
        entity_progress(log, first_of=[start], last_of=[end])
        .join(by_merge(amounts), "application_id", "left")
        .agg(
            *columns(
                [
                    f"coalesce(sum({reached(log, start)}), 0L) AS submitted",
                    f"coalesce(sum({reached(log, end)}), 0L) AS disbursed",
                    f"sum({days}) AS days",
                    f"count({days}) AS days_known",
                    f"sum(IF({paid}, loan_amount, 0)) FILTER (WHERE on_book) AS paid_out",
                    f"sum(IF({paid}, 0, loan_amount)) FILTER (WHERE on_book) AS at_risk",
                ]
            )
        )
    )


def dashboard_figures(sums: DataFrame) -> DataFrame:
    """The snapshot from its additive figures, one row."""
    return sums.selectExpr(
        "submitted AS total_applications",
        "disbursed AS total_disbursed",
        "submitted - disbursed AS total_lost",
        f"{percent('disbursed', 'submitted')} AS end_to_end_conv_pct",
        f"{percent('submitted - disbursed', 'submitted')} AS overall_dropoff_pct",
        f"{mean_of('days', 'days_known', 1)} AS avg_days_to_disburse",
        "paid_out AS total_disbursed_value",
        "at_risk AS pipeline_at_risk",
    )


#: View name -> (report, columns a read of the view is sorted by).
VIEWS = {
    "vw_funnel_kpi_summary": (funnel_kpi_summary, ("stage_order",)),
    "vw_stage_dropoff": (stage_dropoff, ("severity_rank", "stage_order")),
    "vw_channel_performance": (channel_performance, ("quality_rank", "channel")),
    "vw_segment_conversion": (segment_performance, ("conv_rank", "loan_type")),
    "vw_executive_dashboard": (executive_dashboard, ()),
}


def create_views(book: LoanBook) -> None:
    """Register the five views; each is evaluated anew whenever it is read."""
    for name, (report, _) in VIEWS.items():
        report(book).createOrReplaceTempView(name)


def read_view(book: LoanBook, name: str) -> DataFrame:
    """Register one view and read it in its usual order."""
    report, order = VIEWS[name]
    report(book).createOrReplaceTempView(name)
    frame = book.application_events.sparkSession.table(name)
    return frame.orderBy(*order) if order else frame

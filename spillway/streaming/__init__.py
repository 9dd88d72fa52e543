"""The funnel and its alerts over a stream of events."""

from .event_time import closed_periods, session_funnel, windowed_funnel
from .live_funnel import first_reached, live_counts, live_funnel, start_live_funnel
from .service_watch import late_rows, longest_wait, service_alerts
from .sizing import state_partitions

__all__ = [
    "closed_periods",
    "first_reached",
    "late_rows",
    "live_counts",
    "live_funnel",
    "longest_wait",
    "service_alerts",
    "session_funnel",
    "start_live_funnel",
    "state_partitions",
    "windowed_funnel",
]

"""DuckDB statements that give the same rows as the registered queries."""

from .operators import OPERATORS
from .reports import REPORTS
from .sources import SOURCES
from .streams import STREAMS
from .strict import STRICT
from .tables import with_tables

STATEMENTS = {
    name: with_tables(body)
    for name, body in {**REPORTS, **SOURCES, **STREAMS, **OPERATORS, **STRICT}.items()
}

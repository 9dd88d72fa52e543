"""Every query by name: ``name -> f(spark, folder) -> DataFrame``."""

from .operators import OPERATORS
from .reports import MODELS, REPORTS, flagship
from .sources import SOURCES
from .streams import STREAMS

QUERIES = {**REPORTS, **MODELS, **SOURCES, **STREAMS, **OPERATORS}

__all__ = ["QUERIES", "flagship"]

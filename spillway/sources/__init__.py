"""Tables, files and the mapping from order data to a loan book."""

from .book import LoanBook
from .files import (
    conform,
    load_delimited,
    read_delimited,
    read_delimited_book,
    read_parquet_book,
    read_table_book,
    write_bucketed_book,
    write_parquet_book,
    write_report,
)
from .layout import interleaved, rows_scanned, write_interleaved
from .orders import clickstream_log, loan_book_from_orders, read_table
from .partitions import latest, merge, merge_latest, overwrite_partitions, read_partitions
from .quarantine import accepted, load_or_reject, reject_counts, rejected
from .schemas import CLUSTERING, CONSTRAINTS, DEFAULTS, SCHEMAS
from .scratch import remove_folder, shared_folder

__all__ = [
    "CLUSTERING",
    "CONSTRAINTS",
    "DEFAULTS",
    "SCHEMAS",
    "LoanBook",
    "accepted",
    "clickstream_log",
    "conform",
    "interleaved",
    "latest",
    "load_delimited",
    "load_or_reject",
    "loan_book_from_orders",
    "merge",
    "merge_latest",
    "overwrite_partitions",
    "read_delimited",
    "read_delimited_book",
    "read_parquet_book",
    "read_partitions",
    "read_table",
    "read_table_book",
    "reject_counts",
    "rejected",
    "remove_folder",
    "rows_scanned",
    "shared_folder",
    "write_bucketed_book",
    "write_interleaved",
    "write_parquet_book",
    "write_report",
]

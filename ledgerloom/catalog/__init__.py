"""All registered queries."""

from ledgerloom.catalog import (  # noqa: F401  (registration)
    document_queries,
    file_queries,
    job_queries,
    ledger_queries,
    reply_queries,
    store_queries,
    stream_queries,
)
from ledgerloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Queries over the given tables, one module per area."""

from . import (  # noqa: F401
    chunk_plans,
    filing_plans,
    listing_plans,
    record_plans,
    search_plans,
    sink_plans,
    split_plans,
    stream_plans,
    summary_plans,
    value_plans,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Names of the core queries for the driver, collected from the modules that define them."""

from __future__ import annotations

from . import catalog
from . import text_queries, quality_queries, join_queries, metric_queries, vote_queries, sampling_queries, change_queries, source_queries, stream_queries  # noqa: F401

flagship = catalog.QUERIES["curated_class_counts"]


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.SQL)

"""Queries over the given tables, each with the SQL that answers it independently."""

from symloom.catalog.registry import ORACLES, QUERIES
from symloom.catalog import (  # noqa: F401,E402 - importing registers the queries
    flow_queries,
    graph_queries,
    join_queries,
    position_queries,
    scalar_queries,
    scoring_queries,
    source_queries,
    table_queries,
)

__all__ = ["ORACLES", "QUERIES"]

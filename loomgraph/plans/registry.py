"""All queries of the engine by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from . import graph_queries, ingest_queries, more_queries, row_queries, search_queries, stream_queries, text_queries  # noqa: F401  they register their queries
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""All queries of the engine's own operators, by name, and their SQL."""

from . import chunk_queries, media_queries, planning_queries, signal_queries, streaming_queries, timeline_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

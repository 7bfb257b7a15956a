"""All queries over the engine's tables, and their SQL."""

from __future__ import annotations

from . import frame_queries, live_queries, scalar_queries, session_queries, store_queries, training_queries

ALL = {**frame_queries.QUERIES, **live_queries.QUERIES, **session_queries.QUERIES, **store_queries.QUERIES, **training_queries.QUERIES, **scalar_queries.QUERIES}
QUERIES = {name: f for name, (f, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}

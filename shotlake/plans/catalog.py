"""Named queries over the fixture tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotlake.plans import document_queries, frame_queries, function_queries, identity_queries, matching_queries, speech_queries

_MODULES = (frame_queries, speech_queries, identity_queries, function_queries, matching_queries, document_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for m in _MODULES for f in m.QUERIES}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

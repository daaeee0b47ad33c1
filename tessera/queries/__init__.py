"""Registered queries over the star, event and document tables, with their DuckDB SQL."""

from tessera.queries.registry import ORACLE_SQL, QUERIES
from tessera.queries import catalog, checks, evaluation, extraction, judging, lookup, plans, relational, requests, retrieval, steps, streams, texts, validation  # noqa: F401, E402

__all__ = ["ORACLE_SQL", "QUERIES"]

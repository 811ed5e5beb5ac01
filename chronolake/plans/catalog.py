"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from . import answer_queries, chunk_queries, context_queries, graph_queries, line_queries, lookup_queries, merge_queries, row_queries, search_queries, time_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Hybrid search over documents and embeddings."""
    return search_queries.search(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

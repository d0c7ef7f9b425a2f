"""The registered queries and their SQL."""

from quoin.plans import agreement_queries, bibliography_queries, grounding_queries, ingest_queries, judging_queries, library_queries, retrieval_queries, source_queries, text_queries  # noqa: F401
from quoin.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

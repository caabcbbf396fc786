"""All registered queries of the engine."""

from __future__ import annotations

from answerloom.plans import answer_queries, corpus_queries, text_queries
from answerloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "answer_queries", "corpus_queries", "text_queries"]

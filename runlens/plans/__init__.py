"""Registered queries with their SQL twins."""

from runlens.plans import (  # noqa: F401  (importing registers the queries)
    corpus_queries, distribution_queries, prompt_queries, result_queries, span_queries)
from runlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

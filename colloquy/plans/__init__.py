"""Registered queries of the engine's own operators."""

from colloquy.plans import analytics_queries, policy_queries, scoring_queries, source_queries, text_queries, trace_queries  # noqa: F401
from colloquy.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

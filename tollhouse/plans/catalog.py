"""All queries: importing this module registers them."""

from __future__ import annotations

from tollhouse.plans import queries_cost, queries_limits, queries_parse, queries_pii, queries_rollup, queries_sources, queries_stream  # noqa: F401
from tollhouse.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

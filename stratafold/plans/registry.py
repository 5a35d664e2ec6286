"""All queries of the engine and their SQL: importing a module of queries registers them."""

from __future__ import annotations

from stratafold.plans import catalog_queries, codec_queries, script_queries  # noqa: F401
from stratafold.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

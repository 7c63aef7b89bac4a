"""All registered queries and their SQL."""

from __future__ import annotations

from workload import queries_base, queries_core, queries_mart  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

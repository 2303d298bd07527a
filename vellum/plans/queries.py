"""All queries of the layout library and the SQL they are held against."""

from __future__ import annotations

from vellum.plans import layout_queries, page_queries, report_queries, run_queries, scalar_queries  # noqa: F401  they register themselves
from vellum.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

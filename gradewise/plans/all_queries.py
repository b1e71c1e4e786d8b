"""Every registered query."""

from __future__ import annotations

from gradewise.plans import analysis_queries, sample_queries, scoring_queries, selection_queries  # noqa: F401
from gradewise.plans.catalog import QUERIES, SQL, run

__all__ = ["QUERIES", "SQL", "run"]

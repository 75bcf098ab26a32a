"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from .queries import evals, intake, runs, selection, texts  # noqa: F401  (they register themselves)
from .queries.registry import ORACLES, QUERIES
from .queries.runs import family_collapse as flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]

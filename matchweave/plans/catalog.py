"""All queries of the library and their DuckDB oracles."""

from __future__ import annotations

from matchweave.plans import cohorts, decisions, evaluation, history, joins, matchups, metrics, models, prematch, probability, ratings, sources, streams
from matchweave.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cohorts", "decisions", "evaluation", "history", "joins", "matchups", "metrics", "models", "prematch", "probability", "ratings", "sources", "streams"]

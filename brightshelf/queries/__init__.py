"""Registered queries over the test tables, each beside its oracle SQL where SQL can say it."""

from __future__ import annotations

from brightshelf.queries import candidates, evaluation, experiments, features, lookups, monitoring, quality, sources, streams, training, vectors  # noqa: F401
from brightshelf.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries."""

from __future__ import annotations

from duelframe.plans import queries_aggregates, queries_features, queries_joins, queries_ledger, queries_models, queries_regression, queries_reports, queries_sources, queries_scalars, queries_sql, queries_streams, queries_windows  # noqa: F401
from duelframe.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

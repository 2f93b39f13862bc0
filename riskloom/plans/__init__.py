"""Registered queries and the SQL they are checked against."""

from riskloom.plans import base  # noqa: F401
from riskloom.plans import (  # noqa: F401  isort: skip
    panel_queries, backtests, risk_queries, portfolio_queries, factor_queries, tail_queries, scenario_queries, daily_queries, simulation_queries, selection_queries, compare_queries, sources_queries,
)
from riskloom.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401

"""Imports every module that registers queries."""

from tidewatt.catalog import (  # noqa: F401
    aggregates,
    checks,
    expressions,
    forecasting,
    gridding,
    joining,
    reporting,
    scans,
    scenario_queries,
    windowing,
)
from tidewatt.catalog.registry import ORACLES, QUERIES  # noqa: F401

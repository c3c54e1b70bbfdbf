"""Forecast plus scenarios to quarterly strain: the flagship query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.operators.keyed import attach
from tidewatt.operators.scenarios import DEFAULT_SCENARIOS, apply_scenarios, scenario_strain


def strain_under_scenarios(
    forecast: DataFrame,
    threshold: DataFrame,
    scenarios: Sequence[Mapping] | DataFrame = DEFAULT_SCENARIOS,
    shape: str = "flat",
    keys: Sequence[str] = (),
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Peak and high hours per (keys, year, quarter, scenario), baseline included once.

    ``threshold`` has one row per series; the scenario rows are never shuffled as such,
    only their partial aggregates.
    """
    judged = attach(forecast, threshold, keys, spread_by=["timestamp"])
    rows = apply_scenarios(judged, scenarios, shape, keys=[*keys, "threshold"], years=years)
    return scenario_strain(rows, F.col("threshold"), keys=keys)

"""Equi-joins of series tables; every join key includes the time, so no series is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names: covariate columns that join onto the demand spine.
WEATHER_MEASURES = ["temp_c", "dewpoint_c", "rel_hum_pct", "wind_spd_kmh", "precip_mm", "stn_press_kpa"]
WEATHER_FLAG = "is_imputed_weather"


def with_weather(
    demand: DataFrame, weather: DataFrame, ts: str = "timestamp", on: Sequence[str] = ()
) -> DataFrame:
    """Every demand row, with the measures of the same time (and of the same ``on`` keys)."""
    if "temp_c" not in weather.columns:
        raise ValueError(f"weather needs temp_c, has {weather.columns}")
    wanted = [c for c in (*WEATHER_MEASURES, WEATHER_FLAG) if c in weather.columns]
    return demand.join(weather.select(*on, ts, *wanted), [*on, ts], "left")


def aligned(df: DataFrame, actual: str = "y", predicted: str = "y_hat") -> DataFrame:
    """Rows where both are known."""
    return df.dropna(subset=[actual, predicted])


def align_tables(
    actual: DataFrame,
    predicted: DataFrame,
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    columns: tuple[str, str] = ("y", "y_hat"),
) -> DataFrame:
    """Actual and predicted values of two tables, where both are known."""
    y, y_hat = columns
    left = actual.select(*keys, ts, y).where(F.col(y).isNotNull())
    right = predicted.select(*keys, ts, y_hat).where(F.col(y_hat).isNotNull())
    return left.join(right, [*keys, ts], "inner")


def restricted_to(df: DataFrame, kept: DataFrame, ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` whose series time occurs in ``kept``."""
    return df.join(kept.select(*keys, ts), [*keys, ts], "left_semi")


def missing_from(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected entries that do not occur."""
    return expected.join(present.select(*on), list(on), "left_anti")

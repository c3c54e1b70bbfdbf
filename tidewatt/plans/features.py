"""Demand and weather tables to the model dataset."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.functions.calendar import (
    BASE_TEMP_C,
    TRAIN_END,
    VAL_END,
    split_label,
    with_calendar,
    with_degree_days,
)
from tidewatt.functions.cleaning import known_or_error
from tidewatt.operators import contracts, grid
from tidewatt.operators.buckets import STEPS_PER_BUCKET
from tidewatt.operators.joins import WEATHER_FLAG, WEATHER_MEASURES, with_weather
from tidewatt.operators.lookback import fill_and_look_back
from tidewatt.operators.windows import HOURLY_LAGS, HOURLY_MEANS

# Fixed names: columns of the model dataset, in order.
DATASET_COLUMNS = [
    "timestamp",
    "y",
    "market_demand_mw",
    *WEATHER_MEASURES,
    "hdd_18",
    "cdd_18",
    "hour",
    "day_of_week",
    "month",
    "year",
    "quarter",
    "is_weekend",
    "hour_sin",
    "hour_cos",
    "doy_sin",
    "doy_cos",
    *HOURLY_LAGS,
    *HOURLY_MEANS,
    "is_imputed",
    "weather_was_missing",
    "split",
]


@dataclasses.dataclass(frozen=True)
class FeatureSettings:
    """Defaults are those of one hourly series; a daily run passes its own steps and dates."""

    keys: tuple[str, ...] = ()
    weather_on: tuple[str, ...] = ()
    target: str = "ontario_demand_mw"
    freq: str = "1 hour"
    lags: Mapping[str, int] = dataclasses.field(default_factory=lambda: dict(HOURLY_LAGS))
    means: Mapping[str, int] = dataclasses.field(default_factory=lambda: dict(HOURLY_MEANS))
    base_temp: float = BASE_TEMP_C
    train_end: str = TRAIN_END
    val_end: str = VAL_END
    steps: int | None = STEPS_PER_BUCKET

    def columns(self) -> list[str]:
        swapped = {**dict(zip(HOURLY_LAGS, self.lags)), **dict(zip(HOURLY_MEANS, self.means))}
        hourly = {*HOURLY_LAGS, *HOURLY_MEANS}
        named = [swapped.get(c, None if c in hourly else c) for c in DATASET_COLUMNS]
        return [*self.keys, *[c for c in named if c]]


def weather_flagged(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with ``weather_was_missing``, and the joined measures that are to be filled (not precipitation)."""
    measures = [c for c in WEATHER_MEASURES if c in df.columns and c != "precip_mm"]
    imputed = F.coalesce(F.col(WEATHER_FLAG), F.lit(False)) if WEATHER_FLAG in df.columns else F.lit(False)
    return df.withColumn("weather_was_missing", F.col("temp_c").isNull() | imputed), measures


def weather_filled(df: DataFrame, keys: Sequence[str] = (), freq: str = "1 hour") -> DataFrame:
    """Fill the joined measures and set ``weather_was_missing``."""
    flagged, measures = weather_flagged(df)
    return grid.fill(flagged, measures, keys=keys, freq=freq)


def dry_where_unknown(df: DataFrame) -> DataFrame:
    """No precipitation where none is reported; comes before the other fills."""
    if "precip_mm" not in df.columns:
        return df
    return df.withColumn("precip_mm", F.coalesce("precip_mm", F.lit(0.0)))


def model_dataset(demand: DataFrame, weather: DataFrame, settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Join, fill and lags, degree days, calendar, split, target; ordered projection.

    Filling and lags share one bucketed frame, so the joined rows are shuffled once.
    A null target and steps that are missing or repeated are errors, found on the way.
    """
    s = settings
    joined, measures = weather_flagged(dry_where_unknown(with_weather(demand, weather, on=s.weather_on)))
    lagged = fill_and_look_back(joined, measures, s.target, s.lags, s.means, keys=s.keys, freq=s.freq, steps=s.steps)
    featured = with_calendar(with_degree_days(lagged, base=s.base_temp))
    labelled = featured.withColumns(
        {"split": split_label(F.col("timestamp"), s.train_end, s.val_end), "y": known_or_error(s.target)}
    )
    return labelled.select(*[c for c in s.columns() if c in labelled.columns])


def dataset_findings(demand: DataFrame, weather: DataFrame, settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """What would spoil the join: repeated times on either side, unknown target."""
    s = settings
    entries = contracts.time_entries(demand, "unique_demand", s.keys, target=s.target)
    entries = entries.unionByName(contracts.time_entries(weather, "unique_weather", s.weather_on))
    return contracts.report_entries(entries, dict.fromkeys(("unique_demand", "unique_weather", "target_not_null"), "error"))

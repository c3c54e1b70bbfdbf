"""Calendar features, split labels, degree days and the trend term."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.functions.timeline import ntz, to_micros

# Fixed values that the results depend on.
DAYS_PER_YEAR = 365.25
BASE_TEMP_C = 18.0
TREND_ORIGIN = "2019-01-01 00:00:00"
TRAIN_END = "2023-12-31 23:00:00"
VAL_END = "2024-12-31 23:00:00"


def hour_ending(date: Column, hour: Column) -> Column:
    """Hour 1..24 labels the hour's end: the row's time is the hour's start."""
    return F.timestamp_add("HOUR", hour.cast("int") - 1, date.cast("timestamp_ntz"))


def with_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """hour, day_of_week (Monday = 0), month, year, quarter, is_weekend and the cyclic pairs."""
    at = F.col(ts)
    day_angle = 2 * math.pi * F.hour(at) / 24
    year_angle = 2 * math.pi * F.dayofyear(at) / DAYS_PER_YEAR
    return df.withColumns(
        {
            "hour": F.hour(at),
            "day_of_week": F.weekday(at),
            "month": F.month(at),
            "year": F.year(at),
            "quarter": F.quarter(at),
            "is_weekend": F.weekday(at).isin(5, 6),
            "hour_sin": F.sin(day_angle),
            "hour_cos": F.cos(day_angle),
            "doy_sin": F.sin(year_angle),
            "doy_cos": F.cos(year_angle),
        }
    )


def with_degree_days(df: DataFrame, temp: str = "temp_c", base: float = BASE_TEMP_C) -> DataFrame:
    """Heating and cooling degrees. ``greatest`` skips nulls, so the null case is spelled out."""
    known = F.col(temp).isNotNull()
    return df.withColumns(
        {
            "hdd_18": F.when(known, F.greatest(F.lit(0.0), F.lit(base) - F.col(temp))),
            "cdd_18": F.when(known, F.greatest(F.lit(0.0), F.col(temp) - F.lit(base))),
        }
    )


def years_since(ts: Column, origin: str = TREND_ORIGIN) -> Column:
    return to_micros(ts, origin) / F.lit(DAYS_PER_YEAR * 86_400 * 1_000_000)


def split_label(ts: Column, train_end: str = TRAIN_END, val_end: str = VAL_END) -> Column:
    """Both ends belong to the earlier split; a null time is ``test``, as is everything late."""
    return (
        F.when(ts <= ntz(train_end), F.lit("train"))
        .when(ts <= ntz(val_end), F.lit("val"))
        .otherwise(F.lit("test"))
    )


def quarter_label(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"))

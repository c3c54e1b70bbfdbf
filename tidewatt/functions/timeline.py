"""Time arithmetic on TIMESTAMP_NTZ columns, free of the session time zone.

A timestamp is handled as the number of microseconds since 1970-01-01 of its own
naive calendar, built from its date and its time of day. ``date_trunc`` and
``timestampdiff`` are avoided: both pass through the session zone, where the hour
skipped by daylight saving collapses into the next one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
_EPOCH = "1970-01-01 00:00:00"
_DAY_MICROS = 86_400_000_000


def step_micros(freq: str) -> int:
    """``"1 hour"`` -> 3_600_000_000. Only units of fixed length are time steps."""
    count, unit = freq.split()
    seconds = _SECONDS.get(unit.rstrip("s"))
    if seconds is None or int(count) < 1:
        raise ValueError(f"not a fixed time step: {freq!r}")
    return int(count) * seconds * 1_000_000


def ntz(text: str) -> Column:
    """A naive timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


def to_micros(ts: Column | str, origin: str = _EPOCH) -> Column:
    """Whole days, and the time of day as an interval, which is short enough to be scaled."""
    day = _col(ts).cast("date")
    inside = ((_col(ts) - day.cast("timestamp_ntz")) * 1_000_000).cast("interval second").cast("bigint")
    micros = F.unix_date(day) * F.lit(_DAY_MICROS) + inside
    return micros if origin == _EPOCH else micros - F.lit(_literal_micros(origin))


def _literal_micros(text: str) -> int:
    return (dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def from_micros(t: Column | str) -> Column:
    return F.timestamp_add("MICROSECOND", _col(t), ntz(_EPOCH))


def floor_micros(t: Column | str, width: int) -> Column:
    """The multiple of ``width`` at or below ``t``, in whole numbers."""
    t = _col(t)
    return t - F.pmod(t, F.lit(width))


def floor_to(ts: Column | str, freq: str) -> Column:
    """Start of the time step that holds ``ts``."""
    return from_micros(floor_micros(to_micros(ts), step_micros(freq)))


def month_start(ts: Column | str) -> Column:
    return F.trunc(_col(ts).cast("date"), "month")


def plus_days(ts: Column | str, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(days), _col(ts))


def with_naive_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Cast the time column to TIMESTAMP_NTZ where it is something else."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c

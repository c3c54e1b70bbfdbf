"""Lags, rolling means, time differences, duplicates and first-maximum rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.operators.buckets import AT, BUCKET, OWN, STEPS_PER_BUCKET, bucket_width, into_buckets, with_known
from tidewatt.operators.keyed import attach
from tidewatt.operators.lookback import fill_and_look_back

# Look-back of the hourly features, in steps.
HOURLY_LAGS = {"demand_lag_1h": 1, "demand_lag_24h": 24, "demand_lag_168h": 168}
HOURLY_MEANS = {"demand_rollmean_24h": 24, "demand_rollmean_168h": 168}


def with_lags_and_means(
    df: DataFrame,
    value: str = "y",
    lags: Mapping[str, int] = HOURLY_LAGS,
    means: Mapping[str, int] = HOURLY_MEANS,
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
    steps: int | None = STEPS_PER_BUCKET,
) -> DataFrame:
    """Values ``k`` rows back and means of the ``n`` rows before the current one, as in
    :func:`tidewatt.operators.lookback.fill_and_look_back`, with nothing to fill."""
    return fill_and_look_back(df, (), value, lags, means, ts, keys, freq, steps)


def with_previous_time(
    df: DataFrame,
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
    steps: int | None = STEPS_PER_BUCKET,
) -> DataFrame:
    """Seconds since the row before it in the series (null on the first), as ``gap_seconds``.

    Rows of the same time give 0: of a duplicated time, all but one row show it.
    """
    rows = into_buckets(df, ts, freq, steps).withColumn("__seen", F.col(AT))
    rows = with_known(rows, ["__seen"], keys, bucket_width(freq, steps))
    # counting back one row inside the bucket sees duplicates and carried rows alike
    before = F.lag(AT, 1).over(Window.partitionBy(*keys, BUCKET).orderBy(AT, F.col(OWN).cast("int")))
    rows = rows.withColumn("gap_seconds", (F.col(AT) - before) / 1_000_000)
    return rows.where(OWN).select(*df.columns, "gap_seconds")


def duplicate_times(df: DataFrame, ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """Series times that occur more than once, with the number of rows."""
    return df.groupBy(*keys, ts).agg(F.count("*").alias("row_count")).where("row_count > 1")


def first_maximum(
    df: DataFrame, metric: str, tie_break: Sequence[Column], keep: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Per group the row with the largest ``metric``; on ties the first by ``tie_break``.

    The maximum is a plain aggregate, and only rows that reach it are compared by the tie
    break: a ranking window would sort every group, a large one in a single task. Null
    metrics never win.
    """
    top = df.groupBy(*keys).agg(F.max(metric).alias("__top"))
    reached = attach(df, top, keys, spread_by=[metric, *keep]).where(F.col(metric) == F.col("__top"))
    order = F.struct(*[t.alias(f"__tie{i}") for i, t in enumerate(tie_break)])
    best = F.min_by(F.struct(*keep, metric), order).alias("__best")
    return reached.groupBy(*keys).agg(best).where("__best IS NOT NULL").select(*keys, "__best.*")

"""Regular time grid and imputation.

Grid steps are whole multiples of ``freq`` from ``origin``; a row between two steps
does not match the grid and is left out, as a re-index would (``off_grid`` in the
contracts lists such rows). A gap is filled by the row before it: every observed row
also emits the missing steps up to its successor, so no calendar table is joined. A time
that a series has twice is an error, found on the way (``duplicate_times`` lists them).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.functions.timeline import from_micros, step_micros, to_micros
from tidewatt.operators.buckets import (
    AT,
    BUCKET,
    OWN,
    STEPS_PER_BUCKET,
    Known,
    bucket_width,
    into_buckets,
    out_of_buckets,
    with_known,
)

IMPUTED_SOURCE = "IMPUTED"
_ORIGIN = "1970-01-01 00:00:00"
_NEW = "__new"
_STEP = "__step"


def on_grid(ts: Column, freq: str, origin: str = _ORIGIN) -> Column:
    return F.pmod(to_micros(ts, origin), F.lit(step_micros(freq))) == 0


def complete_grid(
    df: DataFrame, ts: str = "timestamp", keys: Sequence[str] = (), freq: str = "1 hour", **how
) -> DataFrame:
    """Every step from the first to the last observed one, per series."""
    return _with_gap_rows(df.select(*keys, ts), ts, keys, freq, (), **how).select(*keys, ts)


def reindex(
    df: DataFrame,
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
    source: str | None = "source_file",
    **how,
) -> DataFrame:
    """All columns on the complete grid; new rows hold nulls and the source ``IMPUTED``."""
    rows = _with_gap_rows(df, ts, keys, freq, (), **how)
    values = {c: F.when(~F.col(_NEW), F.col(c)) for c in df.columns if c not in (ts, *keys)}
    if source:
        values[source] = F.when(F.col(_NEW), F.lit(IMPUTED_SOURCE)).otherwise(F.col(source))
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in df.columns])


def regularise(
    df: DataFrame,
    columns: Sequence[str],
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
    flag: str = "is_imputed",
    flag_columns: Sequence[str] | None = None,
    source: str | None = None,
    **how,
) -> DataFrame:
    """Complete grid with ``columns`` filled and ``flag`` set where a value was made up.

    A row is flagged when it is new or when one of ``flag_columns`` (default: all of
    ``columns``) was null. Filling is linear in time between known neighbours, then
    forward, then backward. Grid and filling share one shuffle.
    """
    watched = columns if flag_columns is None else flag_columns
    rows = _with_gap_rows(df, ts, keys, freq, columns, **how)
    step = F.col(_STEP)
    was_null = F.lit(False)
    for c in watched:
        was_null = was_null | F.col(c).isNull()
    values = {
        c: F.when(~F.col(_NEW) & F.col(c).isNotNull(), F.col(c)).otherwise(Known(c).filled(step))
        for c in columns
    }
    if source:
        values[source] = F.when(F.col(_NEW), F.lit(IMPUTED_SOURCE)).otherwise(F.col(source))
    kept = [c for c in df.columns if c != flag]
    carried = {ts, *keys}
    out = [
        values.get(c, F.col(c) if c in carried else F.when(~F.col(_NEW), F.col(c))).alias(c)
        for c in kept
    ]
    return rows.select(*out, (F.col(_NEW) | was_null).alias(flag))


def interpolate(df: DataFrame, columns: Sequence[str], **how) -> DataFrame:
    """Linear in time between known neighbours; trailing nulls take the last value."""
    return _fill(df, {c: Known(c).interpolated(F.col(AT)) for c in columns}, **how)


def forward_fill(df: DataFrame, columns: Sequence[str], **how) -> DataFrame:
    return _fill(df, {c: Known(c).before for c in columns}, **how)


def backward_fill(df: DataFrame, columns: Sequence[str], **how) -> DataFrame:
    return _fill(df, {c: Known(c).after for c in columns}, **how)


def fill(df: DataFrame, columns: Sequence[str], **how) -> DataFrame:
    """Interpolation, forward fill and backward fill in one pass over existing rows."""
    return _fill(df, {c: Known(c).filled(F.col(AT)) for c in columns}, **how)


def fill_bucketed(df: DataFrame, fills: Mapping[str, Column], keys: Sequence[str], width: int | None) -> DataFrame:
    """The same on a frame that is already in buckets, to share its shuffle."""
    known = with_known(df, list(fills), keys, width)
    filled = {c: F.coalesce(F.col(c), value) for c, value in fills.items()}
    return known.withColumns(filled).drop(*[t for c in fills for t in Known(c).temporary()])


def _fill(
    df: DataFrame,
    fills: Mapping[str, Column],
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
    steps: int | None = STEPS_PER_BUCKET,
) -> DataFrame:
    bucketed = into_buckets(df, ts, freq, steps)
    done = out_of_buckets(fill_bucketed(bucketed, fills, keys, bucket_width(freq, steps)))
    return done.select(*df.columns)


def _with_gap_rows(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    freq: str,
    columns: Sequence[str],
    steps: int | None = STEPS_PER_BUCKET,
    origin: str = _ORIGIN,
) -> DataFrame:
    """Observed rows and, after each, one row per missing step; values are repeated as is."""
    step = step_micros(freq)
    seen = into_buckets(df.where(on_grid(F.col(ts), freq, origin)), ts, freq, steps)
    # the time itself, as a column that is always known, finds the next observed row
    seen = seen.withColumn("__seen", F.col(AT))
    around = with_known(seen, ["__seen", *columns], keys, bucket_width(freq, steps))
    following = Known("__seen").after
    twice = F.raise_error(F.concat(F.lit("duplicate time "), F.col(ts).cast("string"))).cast("long")
    apart = F.when(following == F.col(AT), twice).otherwise(following - F.col(AT))
    missing = F.greatest(F.lit(1).cast("long"), F.coalesce(apart / step, F.lit(1)).cast("long"))
    # two levels, so that no gap becomes one large array
    block = F.lit(STEPS_PER_BUCKET).cast("long")
    blocks = around.where(OWN).withColumn("__n", missing).withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, block))
    )
    offsets = F.sequence(F.col("__from"), F.least(F.col("__from") + block, F.col("__n")) - 1)
    rows = blocks.withColumn("__offset", F.explode(offsets))
    return (
        rows.withColumn(_NEW, F.col("__offset") > 0)
        .withColumn(_STEP, F.col(AT) + F.col("__offset") * step)
        .withColumn(ts, from_micros(_STEP))
        .drop("__n", "__from", "__offset", "__seen", AT, BUCKET, OWN)
    )


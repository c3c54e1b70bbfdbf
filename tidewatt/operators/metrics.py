"""Forecast errors, strain, profiles and coverage figures. All are plain aggregates, which
combine partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.functions.timeline import floor_to, month_start, step_micros, to_micros
from tidewatt.operators.grid import IMPUTED_SOURCE
from tidewatt.operators.keyed import attach
from tidewatt.operators.quantile import exact_percentiles

SPLITS = ["train", "val", "test"]


# --- forecast against actual -------------------------------------------------


def quarterly_strain(
    df: DataFrame,
    threshold: Column,
    by: Sequence[str] = (),
    ts: str = "timestamp",
    actual: str = "y",
    predicted: str = "y_hat",
) -> DataFrame:
    """Peaks and steps strictly above the threshold, per (by, year, quarter)."""
    return (
        df.groupBy(*by, F.year(ts).alias("year"), F.quarter(ts).alias("quarter"))
        .agg(
            F.max(actual).alias("actual_peak_mw"),
            F.max(predicted).alias("predicted_peak_mw"),
            F.count_if(F.col(actual) > threshold).alias("actual_high_hours"),
            F.count_if(F.col(predicted) > threshold).alias("predicted_high_hours"),
        )
        .withColumn("peak_uplift_mw", F.col("predicted_peak_mw") - F.col("actual_peak_mw"))
    )


def monthly_peaks(
    df: DataFrame, by: Sequence[str] = (), ts: str = "timestamp", actual: str = "y", predicted: str = "y_hat"
) -> DataFrame:
    """Largest actual and largest predicted value per month; they need not share a time."""
    return df.groupBy(*by, month_start(ts).alias("month")).agg(
        F.max(actual).alias(actual), F.max(predicted).alias(predicted)
    )


def monthly_peak_mae(df: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    peaks = monthly_peaks(df, by, ts)
    return peaks.groupBy(*by).agg(F.avg(F.abs(F.col("y_hat") - F.col("y"))).alias("monthly_peak_mae"))


def forecast_errors(df: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """mae, rmse, monthly_peak_mae and n_samples over the rows where both values are known.

    One pass: sums per month are combined, the months are then few.
    """
    error = F.col("y_hat") - F.col("y")
    months = (
        df.dropna(subset=["y", "y_hat"])
        .groupBy(*by, month_start(ts).alias("month"))
        .agg(
            F.sum(F.abs(error)).alias("abs_sum"),
            F.sum(error * error).alias("square_sum"),
            F.count("*").alias("n"),
            F.abs(F.max("y_hat") - F.max("y")).alias("peak_error"),
        )
    )
    return months.groupBy(*by).agg(
        (F.sum("abs_sum") / F.sum("n")).alias("mae"),
        F.sqrt(F.sum("square_sum") / F.sum("n")).alias("rmse"),
        F.avg("peak_error").alias("monthly_peak_mae"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"),
    )


# --- profiles of one series table ---------------------------------------------


def daily_max(df: DataFrame, value: str = "y", keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(F.max(value).alias(f"max_{value}"))


def hour_of_day_mean(df: DataFrame, value: str = "y", keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(F.avg(value).alias(f"mean_{value}"))


def target_stats(df: DataFrame, value: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    )


def split_shares(df: DataFrame, keys: Sequence[str] = (), split: str = "split") -> DataFrame:
    """Rows and percentage per split, also for a split without rows."""
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("total"), *[F.count_if(F.col(split) == s).alias(s) for s in SPLITS]
    )
    pairs = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("row_count")) for s in SPLITS])
    return counts.select(*keys, "total", F.inline(pairs)).select(
        *keys,
        "split",
        "row_count",
        F.try_divide(F.col("row_count") * 100.0, F.col("total")).alias("percent"),
    )


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: null count, null rate and whether every row is null."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count("*").alias("__total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in columns])
    rate = F.try_divide(F.col("null_count").cast("double"), F.col("__total"))
    return counts.select("__total", F.inline(pairs)).select(
        "column",
        "null_count",
        rate.alias("null_rate"),
        (F.col("null_count") == F.col("__total")).alias("all_null"),
    )


def worst_null_rates(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """The ``top`` columns by null rate, of those that have nulls at all."""
    return null_rates(df, columns).orderBy(F.desc("null_rate"), "column").limit(top).where("null_rate > 0")


def rows_with_nulls(df: DataFrame, leave_out: str = "precip_mm") -> DataFrame:
    """Rows with any null, over all columns and without one of them."""

    def any_null(columns):
        test = F.lit(False)
        for c in columns:
            test = test | F.col(c).isNull()
        return test

    total = F.count("*")
    every = F.count_if(any_null(df.columns))
    without = F.count_if(any_null([c for c in df.columns if c != leave_out]))
    return df.agg(
        total.alias("row_count"),
        every.alias("null_rows"),
        F.try_divide(every * 100.0, total).alias("null_rows_pct"),
        without.alias(f"null_rows_without_{leave_out}"),
        F.try_divide(without * 100.0, total).alias(f"null_rows_without_{leave_out}_pct"),
    )


def coverage(df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(ts).alias("start_timestamp"), F.max(ts).alias("end_timestamp"), F.count("*").alias("row_count")
    )


def rows_per_year(df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(F.count("*").alias("row_count"))


def year_completeness(
    df: DataFrame,
    start_year: int,
    end_year: int,
    keys: Sequence[str] = (),
    ts: str = "timestamp",
    freq: str = "1 hour",
) -> DataFrame:
    """Per series and year: rows, rows of a full year, coverage and a status.

    ``No data``; ``PARTIAL`` when the year's last step is missing or rows are; else
    ``Complete``. Series without any row are unknown and not listed.
    """
    step = step_micros(freq)
    seen = df.groupBy(*keys, F.year(ts).alias("year")).agg(
        F.max(ts).alias("last_timestamp"), F.count("*").alias("row_count")
    )
    years = F.explode(F.sequence(F.lit(start_year), F.lit(end_year))).alias("year")
    wanted = seen.groupBy(*keys).agg(F.count("*").alias("__years")).select(*keys, years)
    begin = F.make_date(F.col("year"), F.lit(1), F.lit(1))
    end = F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    expected = (F.datediff(end, begin).cast("long") * F.lit(86_400_000_000 // step)).alias("expected_rows")
    last_step = to_micros(end.cast("timestamp_ntz")) - F.lit(step)
    rows = F.coalesce("row_count", F.lit(0))
    status = (
        F.when(rows == 0, F.lit("No data"))
        .when(to_micros("last_timestamp") < last_step, F.lit("PARTIAL"))
        .when(rows < F.col("expected_rows"), F.lit("PARTIAL"))
        .otherwise(F.lit("Complete"))
    )
    return (
        wanted.join(seen, [*keys, "year"], "left")
        .select("*", expected)
        .select(
            *keys,
            "year",
            "last_timestamp",
            rows.alias("row_count"),
            "expected_rows",
            (rows * 100.0 / F.col("expected_rows")).alias("coverage_pct"),
            status.alias("status"),
        )
    )


def missing_steps(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "timestamp",
    freq: str = "1 hour",
    source: str | None = "source_file",
) -> DataFrame:
    """Steps between the first and last observed row that have no observed row."""
    observed = df.where(~F.col(source).eqNullSafe(IMPUTED_SOURCE)) if source else df
    span = (to_micros(F.max(ts)) - to_micros(F.min(ts))) / step_micros(freq)
    return observed.groupBy(*keys).agg(
        F.count("*").alias("observed_rows"), (span.cast("long") + 1 - F.count("*")).alias("missing_steps")
    )


def flag_share(df: DataFrame, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows where a boolean flag is set, and their percentage."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("row_count"),
        F.count_if(flag).alias("flagged_rows"),
        F.try_divide(F.count_if(flag) * 100.0, F.count("*")).alias("flagged_pct"),
    )


def source_count(df: DataFrame, keys: Sequence[str] = (), source: str = "source_file") -> DataFrame:
    """Distinct sources; the first aggregation by source takes the load off large series."""
    return df.groupBy(*keys, source).agg(F.lit(1)).groupBy(*keys).agg(F.count(source).alias("source_count"))


def observed_share(df: DataFrame, value: str = "temp_c", keys: Sequence[str] = ()) -> DataFrame:
    """Known values before any filling."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("observed"),
        F.try_divide(F.count(value) * 100.0, F.count("*")).alias("observed_pct"),
    )


def value_profile(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max and distinct count of a column.

    Equal values are counted first; deviations are those of the counted values from the mean, and the
    quartiles come from refined ranks, so that no group is held or sorted in one task.
    """
    x, n = F.col(value), F.col("__n")
    counts = df.where(x.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    sums = counts.groupBy(*by).agg(
        F.sum(n).alias("count"),
        F.count("*").alias("distinct_values"),
        (F.sum(x * n) / F.sum(n)).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    off = x - F.col("mean")
    squares = attach(counts, sums.select(*by, "mean"), by, [value]).groupBy(*by).agg(
        F.sqrt(F.try_divide(F.sum(off * off * n), F.sum(n) - 1)).alias("std")
    )
    quartiles = exact_percentiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    profile = attach(attach(sums, squares, by, ["count"]), quartiles, by, ["count"])
    return profile.select(*by, "count", "distinct_values", "mean", "std", "min", "max", "q25", "q50", "q75")


def feature_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per feature, in one pass."""
    stats = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in features],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std") for c in features],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std")
            )
            for c in features
        ]
    )
    return stats.select(F.inline(rows))


# --- feature selection ---------------------------------------------------------

# Fixed names: columns that describe a row and never are model inputs.
NOT_FEATURES = {
    "timestamp",
    "y",
    "split",
    "source_file",
    "is_imputed",
    "is_imputed_weather",
    "weather_was_missing",
}


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns that may be model inputs, by name."""
    usable = (T.NumericType, T.BooleanType)
    left_out = NOT_FEATURES | set(exclude)
    return sorted(f.name for f in df.schema if isinstance(f.dataType, usable) and f.name not in left_out)


def complete_cases(df: DataFrame, features: Sequence[str], target: str | None = "y") -> DataFrame:
    return df.dropna(subset=[*features, *([target] if target else [])])


def series_from_events(
    events: DataFrame, at: str, value: str, freq: str, keys: Sequence[str] = (), how=F.sum
) -> DataFrame:
    """One row per series and step with events: the sum (or other aggregate)."""
    return events.groupBy(*keys, floor_to(at, freq).alias("timestamp")).agg(how(value).alias("y"))

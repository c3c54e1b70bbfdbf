"""The data behind each figure and paragraph of a report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.functions.calendar import quarter_label
from tidewatt.functions.timeline import plus_days
from tidewatt.operators.keyed import attach
from tidewatt.operators.metrics import daily_max, monthly_peaks
from tidewatt.operators.scenarios import BASELINE
from tidewatt.operators.windows import first_maximum


def all_metrics(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def rmse_comparison(table: DataFrame, prefer: str = "test") -> DataFrame:
    """(model, rmse) ascending: the first rmse column of the preferred split, else the first one."""
    columns = [c for c in table.columns if "rmse" in c.lower()]
    if not columns:
        raise ValueError(f"no rmse column among {table.columns}")
    chosen = next((c for c in columns if prefer in c.lower()), columns[0])
    return table.where(F.col(chosen).isNotNull()).select("model", F.col(chosen).alias("rmse")).orderBy("rmse", "model")


def peak_day(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, peak_day, peak): the first day that holds the largest value."""
    days = daily_max(preds, "y", keys)
    best = first_maximum(days, "max_y", [F.col("day")], ["day"], keys)
    return best.select(*keys, F.col("day").alias("peak_day"), F.col("max_y").alias("peak"))


def peak_window(
    preds: DataFrame, keys: Sequence[str] = (), days: int = 7, least_rows: int = 24, ts: str = "timestamp"
) -> DataFrame:
    """Rows from midnight ``days`` before the peak day to midnight ``days`` after it, both included.

    A series with fewer than ``least_rows`` rows gives none.
    """
    sizes = preds.groupBy(*keys).agg(F.count("*").alias("__rows"))
    peaks = peak_day(preds, keys)
    facts = peaks.join(sizes, list(keys)) if keys else peaks.withColumn("__rows", sizes.scalar())
    rows = attach(preds, facts.where(F.col("__rows") >= least_rows), keys, spread_by=[ts])
    middle = F.col("peak_day").cast("timestamp_ntz")
    near = F.col(ts).between(plus_days(middle, -days), plus_days(middle, days))
    return rows.where(near).select(*preds.columns, "peak_day")


def monthly_peak_bounds(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ends of the y = x line: smallest and largest monthly peak of either kind."""
    return monthly_peaks(preds, keys).groupBy(*keys).agg(
        F.least(F.min("y"), F.min("y_hat")).alias("low"), F.greatest(F.max("y"), F.max("y_hat")).alias("high")
    )


def by_quarter(strain: DataFrame, value: str, scenarios: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per quarter, one column per scenario."""
    return strain.groupBy(*keys, quarter_label(F.col("year"), F.col("quarter")).alias("quarter_label")).pivot(
        "scenario", list(scenarios)
    ).agg(F.max(value))


def quarterly_peaks(strain: DataFrame, scenarios: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return by_quarter(strain, "predicted_peak_mw", scenarios, keys)


def high_hours_changes(strain: DataFrame, scenarios: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Without the baseline, whose change is 0 by definition."""
    return by_quarter(strain, "high_hours_delta", [s for s in scenarios if s != BASELINE], keys)


def report_facts(table: DataFrame, strain: DataFrame) -> DataFrame:
    """(fact, subject, quarter_label, value): best models, largest peak uplift, most added high hours.

    Nulls never win. Ties go to the first by name, and by quarter and name.
    """
    label = quarter_label(F.col("year"), F.col("quarter")).alias("quarter_label")
    order = [F.col("year"), F.col("quarter"), F.col("scenario")]

    def best_model(fact: str, column: str) -> DataFrame:
        low = table.select("model", (-F.col(column)).alias("__score"))
        best = first_maximum(low, "__score", [F.col("model")], ["model"])
        return _fact(fact, best, F.col("model"), F.lit(None).cast("string"), -F.col("__score"))

    def most(fact: str, column: str) -> DataFrame:
        rows = strain.select("scenario", "year", "quarter", label, F.col(column).cast("double").alias("__score"))
        best = first_maximum(rows, "__score", order, ["scenario", "quarter_label"])
        return _fact(fact, best, F.col("scenario"), F.col("quarter_label"), F.col("__score"))

    return (
        best_model("best_test_rmse", "test_rmse")
        .unionByName(best_model("best_val_rmse", "val_rmse"))
        .unionByName(most("max_peak_uplift", "peak_delta_mw"))
        .unionByName(most("max_high_hours_increase", "high_hours_delta"))
    )


def _fact(name: str, df: DataFrame, subject: Column, label: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("fact"), subject.alias("subject"), label.alias("quarter_label"), value.alias("value")
    ).where(F.col("subject").isNotNull())

"""Yearly demand CSV files: comment lines, then Date, Hour (1..24, hour-ending) and two loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.functions.calendar import hour_ending
from tidewatt.functions.cleaning import known_or_error, plain_number, readable_time
from tidewatt.operators.grid import regularise
from tidewatt.session import staged
from tidewatt.sources.headers import COMMENT, csv_files, file_name, heads, layouts, read_columns

# Fixed names: columns of a demand file and the pattern of its name.
REQUIRED = ["Date", "Hour", "Market Demand", "Ontario Demand"]
PREFLIGHT_LINES = 10  # the check of raw files, not reading, wants the header among these
FILE_PATTERN = "PUB_Demand_*.csv"
LOADS = ["ontario_demand_mw", "market_demand_mw"]


def demand_files(spark: SparkSession, folder: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """(path, file_name, year); the year is null where the name has none."""
    return csv_files(spark, folder, pattern).select("path", "file_name", _year("file_name").alias("year"))


def _year(name: Column | str) -> Column:
    return F.regexp_extract(name, r"PUB_Demand_(\d{4})\.csv$", 1).try_cast("int")


def missing_years(spark: SparkSession, folder: str, years: Sequence[int]) -> DataFrame:
    expected = spark.createDataFrame([(int(y),) for y in years], "year int")
    return expected.join(demand_files(spark, folder).select("year"), ["year"], "left_anti")


def header_findings(spark: SparkSession, folder: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """(path, missing): files without a header among their first lines, or whose header lacks a required column."""
    names = F.transform(F.split("header", ","), lambda c: F.trim(c))
    required = F.array(*[F.lit(c) for c in REQUIRED])
    late = F.col("header").isNull() | (F.col("line") > PREFLIGHT_LINES)
    missing = F.when(late, required).otherwise(F.array_except(required, names))
    return heads(spark, folder, pattern).select("path", missing.alias("missing")).where(F.size("missing") > 0)


def read_demand(
    spark: SparkSession, folder: str, years: Sequence[int] | None = None, pattern: str = FILE_PATTERN
) -> DataFrame:
    """(timestamp, ontario_demand_mw, market_demand_mw, source_file) of all files, unfilled.

    Fails on a missing year, a file without header, a missing column, an unreadable date or
    an hour outside 1..24. The header may stand anywhere; what follows a comment mark is dropped.
    """
    wanted = None
    if years is not None:
        absent = sorted(r["year"] for r in missing_years(spark, folder, years).collect())
        if absent:
            raise FileNotFoundError(f"no demand file for years {absent} in {folder}")
        wanted = _year(file_name("_metadata.file_path")).isin([int(y) for y in years])
    found = staged(heads(spark, folder, pattern, wanted), "heads")
    headless = [r["path"] for r in found.where(F.col("header").isNull()).select("path").collect()]
    if headless:
        raise ValueError(f"no header in {headless}")
    places = {}
    for layout in layouts(found):
        lacking = [name for name in REQUIRED if name not in layout.columns]
        if lacking:
            paths = [r["path"] for r in found.where(F.col("header") == layout.header).select("path").collect()]
            raise ValueError(f"{sorted(paths)} lack columns {lacking}; they have {layout.columns}")
        places[layout.header] = {name: layout.columns.index(name) for name in REQUIRED}
    if not places:
        raise FileNotFoundError(f"no demand files in {folder}")
    rows = read_columns(spark, folder, found, places, pattern, wanted, COMMENT)
    return rows.select(
        _time(F.col("Date"), F.col("Hour")).alias("timestamp"),
        plain_number(F.col("Ontario Demand")).alias("ontario_demand_mw"),
        plain_number(F.col("Market Demand")).alias("market_demand_mw"),
        file_name("file_path").alias("source_file"),
    )


def _time(date: Column, hour: Column) -> Column:
    day, number = readable_time(date), F.trim(hour).try_cast("int")
    bad = F.raise_error(F.concat(F.lit("bad Date or Hour: "), F.coalesce(date, F.lit("null")), F.lit(" "), F.coalesce(hour, F.lit("null"))))
    valid = F.coalesce(number.between(1, 24) & day.isNotNull(), F.lit(False))
    return F.when(valid, hour_ending(day, number)).otherwise(bad.cast("timestamp_ntz"))


def hourly_demand(raw: DataFrame, keys: Sequence[str] = (), **how) -> DataFrame:
    """Complete hourly table: loads filled, ``is_imputed`` where a row is new or a load was null.

    A duplicate time, or a series without any value of the target, is an error.
    """
    filled = regularise(raw, LOADS, keys=keys, flag="is_imputed", source="source_file", **how)
    return filled.withColumn(LOADS[0], known_or_error(LOADS[0]))

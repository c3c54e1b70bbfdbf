"""Monthly weather CSV files in ``<folder>/<year>/``, with headers that vary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.functions.cleaning import dirty_number, known_or_error, readable_time
from tidewatt.operators.grid import regularise
from tidewatt.session import staged
from tidewatt.sources.headers import Layout, csv_files, heads, layouts, parent_folder, read_columns

# Words that identify a column, per measure.
TIME_TOKENS = ("date", "time")
MEASURE_TOKENS = {
    "temp_c": ("temp", "degc"),
    "dewpoint_c": ("dew", "point", "temp", "degc"),
    "rel_hum_pct": ("rel", "hum"),
    "wind_spd_kmh": ("wind", "spd"),
    "precip_mm": ("precip", "amount"),
    "stn_press_kpa": ("stn", "press"),
}
MEASURES = list(MEASURE_TOKENS)
_SCHEMA = "timestamp timestamp_ntz, " + ", ".join(f"{m} double" for m in MEASURES) + ", source_file string"


def weather_files(
    spark: SparkSession, folder: str, start_year: int | None = None, end_year: int | None = None
) -> DataFrame:
    year = F.col("parent").try_cast("int")
    files = csv_files(spark, folder).withColumn("year", year)
    if start_year is not None:
        files = files.where(F.col("year").between(start_year, end_year))
    return files


def read_weather(
    spark: SparkSession, folder: str, start_year: int | None = None, end_year: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): measures of all readable files, and (path, reason) of the others.

    A measure a file lacks is null; rows whose time cannot be read are left out.
    """
    wanted = None
    if start_year is not None:
        wanted = parent_folder("_metadata.file_path").try_cast("int").between(start_year, end_year)
    found = staged(heads(spark, folder, wanted=wanted), "heads")
    groups = layouts(found)
    places = {g.header: _places(g) for g in groups if g.position(*TIME_TOKENS) is not None}
    untimed = [g.header for g in groups if g.header not in places]
    reason = F.when(F.col("header").isNull(), "no header").when(F.col("header").isin(untimed), "no date and time column")
    rejects = found.select("path", reason.alias("reason")).where("reason IS NOT NULL")
    if not groups and rejects.isEmpty():
        raise FileNotFoundError(f"no weather files in {folder} for {start_year}-{end_year}")
    if not places:
        return spark.createDataFrame([], _SCHEMA), rejects
    cells = read_columns(spark, folder, found, places, wanted=wanted)
    source = F.concat_ws("/", F.slice(F.split("file_path", "/"), -2, 2))
    rows = cells.select(
        readable_time(F.col("time")).alias("timestamp"), *[dirty_number(F.col(m)).alias(m) for m in MEASURES], source.alias("source_file")
    )
    return rows.where(F.col("timestamp").isNotNull()), rejects


def _places(layout: Layout) -> dict[str, int | None]:
    # "dew point temp" also contains the words for temperature
    found = {name: layout.position(*tokens, without=("dew",) if name == "temp_c" else ()) for name, tokens in MEASURE_TOKENS.items()}
    return {"time": layout.position(*TIME_TOKENS), **found}


def folder_findings(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, severity, finding): a warning if the folder is absent or holds no file with content."""
    try:
        empty = weather_files(spark, folder).isEmpty()
        finding = "no weather files" if empty else None
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        finding = "no weather folder"
    rows = [(folder, "warning", finding)] if finding else []
    return spark.createDataFrame(rows, "folder string, severity string, finding string")


def hourly_weather(raw: DataFrame, keys: Sequence[str] = (), **how) -> DataFrame:
    """Complete hourly table: all measures filled; ``is_imputed_weather`` looks at the temperature only.

    A duplicate time, or a series without any temperature, is an error.
    """
    filled = regularise(
        raw, MEASURES, keys=keys, flag="is_imputed_weather", flag_columns=["temp_c"], source="source_file", **how
    )
    return filled.withColumn("temp_c", known_or_error("temp_c"))

"""Parquet, CSV and JSON tables that stages hand to each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.functions.cleaning import without_nan
from tidewatt.functions.timeline import with_naive_time
from tidewatt.operators.contracts import require_columns
from tidewatt.operators.scenarios import SCHEMA, ScenarioError

# Description of a scenario file.
SCENARIO_METADATA = {"description": "AI/data center load scenarios", "units": "MW"}


def read_table(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A Parquet table; NaN becomes null."""
    return without_nan(require_columns(spark.read.parquet(path), required, path))


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """A forecast in Parquet or CSV, told apart by the suffix, with timestamp and y_hat."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.rstrip("/").endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")
    df = require_columns(df, ["timestamp", "y_hat"], path)
    return without_nan(with_naive_time(df).withColumn("y_hat", F.col("y_hat").cast("double")))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header: names in lower case with ``_`` for blanks, numbers as double."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    texts = {"model", "scenario", "split"}
    return df.select(*[F.col(c) if c in texts else F.col(c).try_cast("double").alias(c) for c in df.columns])


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a scenario file: ``{"scenarios": [...], "metadata": {...}}``."""
    content = spark.read.option("multiLine", True).json(path)
    if "scenarios" not in content.columns:
        raise ScenarioError(f"{path} has no 'scenarios'")
    entries = spark.read.schema(f"scenarios array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    return entries.option("multiLine", True).json(path).select(F.inline("scenarios"))


def write_scenarios(scenarios: DataFrame | Sequence[Mapping], path: str, spark: SparkSession | None = None) -> None:
    """One JSON object with all entries, which the format requires."""
    if not isinstance(scenarios, DataFrame):
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        scenarios = spark.createDataFrame([tuple(s.get(n) for n in names) for s in scenarios], SCHEMA)
    entry = F.struct(*[part.split()[0] for part in SCHEMA.split(", ")])
    metadata = F.struct(*[F.lit(v).alias(k) for k, v in SCENARIO_METADATA.items()])
    whole = scenarios.agg(F.sort_array(F.collect_list(entry)).alias("scenarios")).withColumn("metadata", metadata)
    whole.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, partitioned by e.g. the split, so that later filters skip whole folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header, for results of a few rows."""
    df.write.mode("overwrite").option("header", True).csv(path)

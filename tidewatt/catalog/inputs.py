"""The driver tables in the roles of demand, weather, forecasts and scenarios.

* hourly demand, one series per event type: 30 days of events;
* daily demand, one series: all orders; or one series per nation of the customer;
* daily weather: shipped line items, whose mean quantity stands for the temperature.

Sums are rounded to cents at the source, so every engine starts from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.functions.timeline import floor_to
from tidewatt.operators import grid
from tidewatt.operators.metrics import series_from_events
from tidewatt.operators.windows import with_lags_and_means
from tidewatt.plans.features import FeatureSettings, model_dataset
from tidewatt.session import staged

# Fixed values of the daily and hourly runs.
DAY_LAGS = {"demand_lag_1d": 1, "demand_lag_7d": 7, "demand_lag_28d": 28}
DAY_MEANS = {"demand_rollmean_7d": 7, "demand_rollmean_28d": 28}
DAY_TRAIN_END, DAY_VAL_END = "1999-12-31 00:00:00", "2000-12-31 00:00:00"
DAY_BASE, DAY_ORIGIN = 25.5, "1995-01-01 00:00:00"
HOUR_TRAIN_END, HOUR_VAL_END = "2024-01-20 23:00:00", "2024-01-25 23:00:00"

DAILY = FeatureSettings(
    freq="1 day",
    lags=DAY_LAGS,
    means=DAY_MEANS,
    base_temp=DAY_BASE,
    train_end=DAY_TRAIN_END,
    val_end=DAY_VAL_END,
)
DAILY_BY_NATION = FeatureSettings(
    keys=("c_nationkey",),
    freq="1 day",
    lags=DAY_LAGS,
    means=DAY_MEANS,
    base_temp=DAY_BASE,
    train_end=DAY_TRAIN_END,
    val_end=DAY_VAL_END,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- hourly, by event type ----------------------------------------------------


def _in_cents(series: DataFrame) -> DataFrame:
    return series.withColumn("y", F.round("y", 2))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, timestamp, y); hours without events are absent."""
    return _in_cents(series_from_events(table(spark, sf_dir, "events"), "ts", "value", "1 hour", ["event_type"]))


def hourly_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the complete grid, with ``is_imputed``."""
    return grid.regularise(hourly(spark, sf_dir), ["y"], keys=["event_type"])


def written_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled hours as a written table, for queries that read them several times."""
    return staged(hourly_filled(spark, sf_dir), "hourly")


def hourly_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid rows whose value is unknown: what the fill operators work on."""
    return grid.reindex(hourly(spark, sf_dir), keys=["event_type"], source=None)


# --- daily ----------------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, y): order value per day."""
    return _in_cents(series_from_events(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "1 day"))


def written_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, y, is_imputed): the filled days as a written table."""
    return staged(grid.regularise(daily(spark, sf_dir), ["y"], freq="1 day"), "daily")


def daily_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_nationkey, timestamp, y). Orders are added up per customer and day first, so a
    customer with very many orders is small before the join."""
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", floor_to("o_orderdate", "1 day").alias("timestamp"))
        .agg(F.sum("o_totalprice").alias("value"))
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return (
        orders.join(customers, "o_custkey")
        .groupBy("c_nationkey", "timestamp")
        .agg(F.round(F.sum("value"), 2).alias("y"))
    )


def daily_demand_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads per day; the second one is unknown on days without pending orders."""
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(floor_to("o_orderdate", "1 day").alias("timestamp"))
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("ontario_demand_mw"),
            F.round(F.sum(pending), 2).alias("market_demand_mw"),
        )
        .withColumn("source_file", F.lit("orders"))
    )


def daily_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regularise(
        daily_demand_raw(spark, sf_dir),
        ["ontario_demand_mw", "market_demand_mw"],
        freq="1 day",
        source="source_file",
    )


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the days with shipments; some are unknown on some of those days."""
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    wet = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), F.col("l_quantity"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(floor_to("l_shipdate", "1 day").alias("timestamp"))
        .agg(
            F.round(F.avg("l_quantity"), 4).alias("temp_c"),
            F.round(F.avg(returned), 4).alias("dewpoint_c"),
            F.round(F.avg(F.col("l_linenumber")), 4).alias("rel_hum_pct"),
            F.sum(wet).alias("precip_mm"),
        )
        .withColumn("is_imputed_weather", F.col("dewpoint_c").isNull())
    )


def daily_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand and weather are written tables, as they are between the stages of a real run:
    the feature stage looks at them twice."""
    demand = staged(daily_demand(spark, sf_dir), "daily-demand")
    weather = staged(daily_weather(spark, sf_dir), "daily-weather")
    return model_dataset(demand, weather, DAILY)


def daily_dataset_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = grid.regularise(daily_by_nation(spark, sf_dir), ["y"], keys=["c_nationkey"], freq="1 day")
    demand = staged(filled.withColumnRenamed("y", "ontario_demand_mw"), "nation-demand")
    weather = staged(daily_weather(spark, sf_dir), "daily-weather")
    return model_dataset(demand, weather, DAILY_BY_NATION)


def written_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily dataset as a written table: the back-test reads it several times."""
    return staged(daily_dataset(spark, sf_dir), "daily-dataset", partition_by=("split",))


def written_dataset_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(daily_dataset_by_nation(spark, sf_dir), "nation-dataset", partition_by=("split",))


def daily_forecast(spark: SparkSession, sf_dir: str, filled: DataFrame | None = None) -> DataFrame:
    """(timestamp, y, y_hat): each day against the same weekday a week before, both known."""
    if filled is None:
        filled = grid.regularise(daily(spark, sf_dir), ["y"], freq="1 day")
    lagged = with_lags_and_means(filled.select("timestamp", "y"), "y", {"y_hat": 7}, {}, freq="1 day")
    return lagged.where(F.col("y_hat").isNotNull())


def hourly_forecast(spark: SparkSession, sf_dir: str, filled: DataFrame | None = None) -> DataFrame:
    """(event_type, timestamp, y, y_hat): each hour against the same hour a day before."""
    if filled is None:
        filled = hourly_filled(spark, sf_dir)
    lagged = with_lags_and_means(filled.select("event_type", "timestamp", "y"), "y", {"y_hat": 24}, {}, keys=["event_type"])
    return lagged.where(F.col("y_hat").isNotNull())


def segment_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario per market segment for 1995..2001: level and growth from its customers."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_mktsegment").alias("name"))
        .agg(
            F.lit(1995).alias("start_year"),
            F.lit(2001).alias("end_year"),
            F.round(F.avg(F.abs("c_acctbal")) * 10, 2).alias("start_mw"),
            F.round(F.count_if(F.col("c_acctbal") > 0) / F.count("*") / 10, 4).alias("yoy_growth"),
        )
    )

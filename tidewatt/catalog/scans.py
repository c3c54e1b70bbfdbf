"""Readers and writers: each query writes a table derived from the driver's, and reads it back."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.forecasting import TWO_LAGS, _two_lag_fit, lag_ridge, small_mlp
from tidewatt.catalog.inputs import (
    daily_by_nation,
    daily_demand,
    daily_demand_raw,
    daily_forecast,
    daily_weather,
    segment_scenarios,
    written_dataset,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.operators import metrics
from tidewatt.session import stage_path
from tidewatt.sources import demand, tables, weather

_TURN = "1998-01-01"


def demand_folder(spark, sf) -> str:
    """Raw demand CSV whose column order changes in 1998; later files begin with a block of
    comments and end each line with one."""
    folder = stage_path(spark, "raw-demand")
    raw = daily_demand_raw(spark, sf).select(
        F.col("timestamp").cast("date").alias("Date"),
        F.lit(1).alias("Hour"),
        F.col("market_demand_mw").alias("Market Demand"),
        F.col("ontario_demand_mw").alias("Ontario Demand"),
    )
    raw.where(F.col("Date") < _TURN).write.option("header", True).csv(f"{folder}/early")
    late = raw.where(F.col("Date") >= _TURN).select("Ontario Demand", "Date", "Market Demand", "Hour")
    # a partition sorted by place keeps the comments and the header above the rows
    lead = [(-100 + i, f"\\ line {i}") for i in range(40)] + [(-1, "Ontario Demand,Date,Market Demand,Hour")]
    head = spark.createDataFrame(lead, "place long, value string")
    line = F.concat(F.to_csv(F.struct(*late.columns)), F.lit(" \\ said later"))
    rows = head.unionByName(late.select(F.lit(0).cast("long").alias("place"), line.alias("value")))
    rows.repartition(1).sortWithinPartitions("place").select("value").write.text(f"{folder}/late")
    return folder


@query(
    "q10_raw_headers",
    """SELECT DISTINCT 'late' AS folder, unnest(['Date', 'Hour', 'Market Demand', 'Ontario Demand']) AS missing FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-01-01'
       UNION ALL SELECT DISTINCT 'narrow', 'Market Demand' FROM orders""",
)
def raw_headers(spark, sf):
    """Files whose header stands far down, and files whose header lacks a column."""
    folder = demand_folder(spark, sf)
    narrow = daily_demand_raw(spark, sf).selectExpr("CAST(timestamp AS DATE) AS Date", "1 AS Hour", "ontario_demand_mw AS `Ontario Demand`")
    narrow.write.option("header", True).csv(f"{folder}/narrow")
    found = demand.header_findings(spark, folder, "*.csv").unionByName(demand.header_findings(spark, folder, "*.txt"))
    place = F.element_at(F.split("path", "/"), -2).alias("folder")
    return found.select(place, F.explode("missing").alias("missing")).distinct()


@query(
    "s1_s2_demand_csv",
    sql.ctes(sql.DEMAND_RAW) + "SELECT * FROM demand_raw",
)
def demand_csv(spark, sf):
    rows = demand.read_demand(spark, demand_folder(spark, sf), pattern="*.{csv,txt}")
    return rows.drop("source_file")


@query(
    "s1_u1_ingested_demand",
    sql.ctes(sql.DEMAND)
    + """SELECT timestamp, round(ontario_demand_mw, 4) AS ontario_demand_mw,
         round(market_demand_mw, 4) AS market_demand_mw, is_imputed FROM demand""",
)
def ingested_demand(spark, sf):
    raw = demand.read_demand(spark, demand_folder(spark, sf), pattern="*.{csv,txt}")
    filled = demand.hourly_demand(raw, freq="1 day")
    return rounded(filled.drop("source_file"), 4)


def weather_folder(spark, sf) -> str:
    """Weather CSV in three layouts, one of them in Latin-1, and files without a time column."""
    folder = stage_path(spark, "raw-weather")
    days = daily_weather(spark, sf)
    time = F.substring(F.col("timestamp").cast("string"), 1, 16).alias("Date/Time (LST)")
    temp, dew = F.col("temp_c").alias("Temp (°C)"), F.col("dewpoint_c").alias("Dew Point Temp (°C)")
    hum, rain = F.col("rel_hum_pct").alias("Rel Hum (%)"), F.col("precip_mm").alias("Precip. Amount (mm)")
    year = F.year("timestamp")
    for name, span, columns, encoding in (
        ("1995", year < 1997, [time, temp, dew, hum, rain], "UTF-8"),
        ("1997", (year >= 1997) & (year < 2000), [dew, temp, rain, hum, time], "ISO-8859-1"),
        ("2000", year >= 2000, [time, hum, temp, dew, rain], "UTF-8"),
        ("1990", year < 1996, [temp, hum], "UTF-8"),
    ):
        rows = days.where(span).select(*columns)
        rows.write.option("header", True).option("encoding", encoding).csv(f"{folder}/{name}")
    return folder


@query(
    "s3_p20_p21_weather_csv",
    sql.ctes(sql.WEATHER)
    + """SELECT timestamp, temp_c, dewpoint_c, rel_hum_pct, NULL::DOUBLE AS wind_spd_kmh, precip_mm,
         NULL::DOUBLE AS stn_press_kpa FROM weather""",
)
def weather_csv(spark, sf):
    rows, _ = weather.read_weather(spark, weather_folder(spark, sf))
    return rows.drop("source_file")


@query(
    "s4_weather_rejects",
    """SELECT DISTINCT 'no date and time column' AS reason, '1990' AS folder FROM lineitem
       WHERE l_shipdate < TIMESTAMP '1996-01-01'""",
)
def weather_rejects(spark, sf):
    _, rejects = weather.read_weather(spark, weather_folder(spark, sf))
    folder = F.element_at(F.split("path", "/"), -2).alias("folder")
    return rejects.select("reason", folder).distinct()


@query(
    "q9_weather_folders",
    """SELECT 'empty' AS folder, 'warning' AS severity, 'no weather files' AS finding
       UNION ALL SELECT 'absent', 'warning', 'no weather folder'
       UNION ALL SELECT 'raw-weather', 'warning', 'no weather files' FROM lineitem HAVING count(*) = 0""",
)
def weather_folders(spark, sf):
    """A folder of weather files, one with files of no bytes, and one that does not exist."""
    full, empty, absent = weather_folder(spark, sf), stage_path(spark, "weather-empty"), stage_path(spark, "weather-absent")
    daily_weather(spark, sf).where(F.lit(False)).select("temp_c").write.csv(empty)
    named = {"raw-weather": full, "empty": empty, "absent": absent}
    found = [weather.folder_findings(spark, path).withColumn("folder", F.lit(name)) for name, path in named.items()]
    return reduce(DataFrame.unionByName, found)


@query(
    "p5_source_folders",
    sql.ctes(sql.WEATHER)
    + """SELECT CASE WHEN year(timestamp) < 1997 THEN '1995' WHEN year(timestamp) < 2000 THEN '1997' ELSE '2000' END
         AS folder, count(*) AS row_count FROM weather GROUP BY 1""",
)
def source_folders(spark, sf):
    rows, _ = weather.read_weather(spark, weather_folder(spark, sf))
    folder = F.split("source_file", "/")[0].alias("folder")
    return rows.groupBy(folder).agg(F.count("*").alias("row_count"))


@query(
    "s5_parquet_scan",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
       AND o_orderstatus = 'F'""",
)
def parquet_scan(spark, sf):
    """Two columns of six, two pushed filters."""
    orders = tables.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])
    recent = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return orders.where(recent & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


def _forecast(spark, sf):
    return rounded(daily_forecast(spark, sf).select("timestamp", "y_hat"), 2)


_FORECAST = sql.ctes(sql.DAILY_FORECAST) + "SELECT timestamp, round(y_hat, 2) AS y_hat FROM forecast"


@query("s6_forecast_parquet", _FORECAST)
def forecast_parquet(spark, sf):
    path = stage_path(spark, "forecast") + ".parquet"
    tables.write_table(_forecast(spark, sf), path)
    return tables.read_forecast(spark, path)


@query("s6_forecast_csv", _FORECAST)
def forecast_csv(spark, sf):
    path = stage_path(spark, "forecast") + ".csv"
    tables.write_report(_forecast(spark, sf), path)
    return tables.read_forecast(spark, path)


@query(
    "s7_s11_metrics_csv",
    sql.ctes(sql.NATION_DAILY)
    + """SELECT 'nation ' || c_nationkey AS model, round(max(y), 2) AS test_rmse, count(*)::DOUBLE AS test_n_samples
         FROM nation_daily GROUP BY c_nationkey""",
)
def metrics_csv(spark, sf):
    path = stage_path(spark, "metrics")
    table_ = (
        daily_by_nation(spark, sf)
        .groupBy(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("Model"))
        .agg(F.max("y").alias("Test RMSE"), F.count("*").alias("Test N Samples"))
    )
    tables.write_report(table_, path)
    return tables.read_metrics(spark, path)


@query("s8_s9_scenario_file", sql.ctes(sql.SEGMENTS) + "SELECT * FROM segments")
def scenario_file(spark, sf):
    path = stage_path(spark, "scenarios")
    tables.write_scenarios(segment_scenarios(spark, sf), path)
    return tables.read_scenarios(spark, path)


@query(
    "s10_partitioned_dataset",
    sql.ctes(sql.DATASET)
    + "SELECT split, count(*) AS row_count, round(max(y), 2) AS y FROM dataset WHERE split <> 'train' GROUP BY 1",
)
def partitioned_dataset(spark, sf):
    """Written by split, so that the filter skips the training folder."""
    kept = written_dataset(spark, sf).where(F.col("split") != "train")
    return rounded(kept.groupBy("split").agg(F.count("*").alias("row_count"), F.max("y").alias("y")), 2)


@query(
    "s10_demand_table",
    sql.ctes(sql.DEMAND) + "SELECT year(timestamp)::INTEGER AS year, count(*) AS row_count FROM demand GROUP BY 1",
)
def demand_table(spark, sf):
    path = stage_path(spark, "demand")
    tables.write_table(daily_demand(spark, sf), path)
    return metrics.rows_per_year(tables.read_table(spark, path, ["timestamp", "ontario_demand_mw"]))


@query(
    "s12_ridge_parameters",
    sql.ctes(sql.DATASET, _two_lag_fit())
    + """SELECT 'intercept' AS feature, round(b0, 2) AS coef FROM fit
      UNION ALL SELECT 'demand_lag_1d', round(b1, 2) + 0.0 FROM fit
      UNION ALL SELECT 'demand_lag_7d', round(b7, 2) + 0.0 FROM fit""",
)
def ridge_parameters(spark, sf):
    dataset, model = written_dataset(spark, sf), lag_ridge(TWO_LAGS)
    train = dataset.where(F.col("split") == "train")
    path = stage_path(spark, "ridge")
    tables.write_table(model.coefficients(train, model.fit(train)), path)
    return rounded(tables.read_table(spark, path, ["feature", "coef"]), 2)


@query("s12_m8_network_scores")
def network_scores(spark, sf):
    """Train, write the parameters, read them back and score validation and test."""
    dataset, model = written_dataset(spark, sf), small_mlp()
    path = stage_path(spark, "network")
    tables.write_table(model.fit(dataset.where(F.col("split") == "train")), path)
    scored = model.transform(dataset.where(F.col("split") != "train"), spark.read.parquet(path))
    return scored.select("timestamp", "split", "y", "y_hat")

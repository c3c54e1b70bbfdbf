"""Errors, strain, profiles and coverage."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.inputs import (
    DAY_TRAIN_END,
    HOUR_TRAIN_END,
    daily,
    daily_by_nation,
    daily_dataset,
    daily_demand,
    daily_forecast,
    daily_weather,
    hourly,
    hourly_filled,
    hourly_forecast,
    segment_scenarios,
    table,
    written_daily,
    written_hourly,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.functions.timeline import ntz
from tidewatt.operators import grid, metrics, quantile, scenarios
from tidewatt.operators.keyed import attach

_TYPE = ["event_type"]
_THRESHOLDS = f"""thresholds AS (SELECT event_type, quantile_cont(y, 0.95) AS threshold FROM hourly_filled
  WHERE timestamp <= TIMESTAMP '{HOUR_TRAIN_END}' GROUP BY 1)"""


def hourly_thresholds(filled):
    train = filled.where(F.col("timestamp") <= ntz(HOUR_TRAIN_END))
    return quantile.exact_percentile(train, "y", 0.95, _TYPE)


def daily_threshold(filled):
    return quantile.exact_percentile(filled.where(F.col("timestamp") <= ntz(DAY_TRAIN_END)), "y", 0.95)


@query(
    "a1_quarterly_strain",
    sql.ctes(sql.DAILY_FORECAST)
    + f""", t AS (SELECT quantile_cont(y, 0.95) AS threshold FROM daily_filled
                  WHERE timestamp <= TIMESTAMP '{DAY_TRAIN_END}')
    SELECT year(timestamp)::INTEGER AS year, quarter(timestamp)::INTEGER AS quarter,
      round(max(y), 4) AS actual_peak_mw, round(max(y_hat), 4) AS predicted_peak_mw,
      count(CASE WHEN y > threshold THEN 1 END) AS actual_high_hours,
      count(CASE WHEN y_hat > threshold THEN 1 END) AS predicted_high_hours,
      round(max(y_hat) - max(y), 4) + 0.0 AS peak_uplift_mw FROM forecast, t GROUP BY 1, 2""",
)
def quarterly_strain(spark, sf):
    filled = written_daily(spark, sf)
    judged = attach(daily_forecast(spark, sf, filled), daily_threshold(filled), [], ["timestamp"])
    return rounded(metrics.quarterly_strain(judged, F.col("threshold")), 4)


@query(
    "a1_quarterly_strain_by_type",
    sql.ctes(sql.HOURLY_FORECAST, _THRESHOLDS)
    + """SELECT event_type, year(timestamp)::INTEGER AS year, quarter(timestamp)::INTEGER AS quarter,
      round(max(y), 6) AS actual_peak_mw, round(max(y_hat), 6) AS predicted_peak_mw,
      count(CASE WHEN y > threshold THEN 1 END) AS actual_high_hours,
      count(CASE WHEN y_hat > threshold THEN 1 END) AS predicted_high_hours,
      round(max(y_hat) - max(y), 6) + 0.0 AS peak_uplift_mw
      FROM hourly_forecast JOIN thresholds USING (event_type) GROUP BY 1, 2, 3""",
)
def quarterly_strain_by_type(spark, sf):
    filled = written_hourly(spark, sf)
    judged = attach(hourly_forecast(spark, sf, filled), hourly_thresholds(filled), _TYPE, ["timestamp"])
    return rounded(metrics.quarterly_strain(judged, F.col("threshold"), _TYPE))


@query(
    "a2_monthly_peaks",
    sql.ctes(sql.DAILY_FORECAST)
    + """SELECT date_trunc('month', timestamp)::DATE AS month, round(max(y), 4) AS y, round(max(y_hat), 4) AS y_hat
         FROM forecast GROUP BY 1""",
)
def monthly_peaks(spark, sf):
    return rounded(metrics.monthly_peaks(daily_forecast(spark, sf)), 4)


@query(
    "a3_monthly_peak_mae",
    sql.ctes(sql.DAILY_FORECAST)
    + f"""SELECT {sql.lean("avg(abs(p - a))", 4)} AS monthly_peak_mae FROM (
         SELECT max(y) AS a, max(y_hat) AS p FROM forecast GROUP BY date_trunc('month', timestamp))""",
)
def monthly_peak_mae(spark, sf):
    return rounded(metrics.monthly_peak_mae(daily_forecast(spark, sf)), 4, lean=sql.LEAN)


_ERRORS = """SELECT {key} floor(sum(a) / sum(n) * 1e{d} + 0.5001) / 1e{d} AS mae,
  floor(sqrt(sum(s) / sum(n)) * 1e{d} + 0.5001) / 1e{d} AS rmse,
  floor(avg(peak) * 1e{d} + 0.5001) / 1e{d} AS monthly_peak_mae, sum(n)::BIGINT AS n_samples FROM (
    SELECT {key} sum(abs(y_hat - y)) AS a, sum((y_hat - y) * (y_hat - y)) AS s, count(*) AS n,
           abs(max(y_hat) - max(y)) AS peak FROM {source} GROUP BY {key} date_trunc('month', timestamp)) {group}"""


@query(
    "a4_a5_a6_forecast_errors",
    sql.ctes(sql.DAILY_FORECAST) + _ERRORS.format(key="", d=3, source="forecast", group=""),
)
def forecast_errors(spark, sf):
    return rounded(metrics.forecast_errors(daily_forecast(spark, sf)), 3, lean=sql.LEAN)


@query(
    "a4_a5_a6_forecast_errors_by_type",
    sql.ctes(sql.HOURLY_FORECAST)
    + _ERRORS.format(key="event_type,", d=6, source="hourly_forecast", group="GROUP BY event_type"),
)
def forecast_errors_by_type(spark, sf):
    return rounded(metrics.forecast_errors(hourly_forecast(spark, sf), _TYPE), lean=sql.LEAN)


@query(
    "a7_threshold",
    sql.ctes(sql.HOURLY_FILLED, _THRESHOLDS) + "SELECT event_type, round(threshold, 6) AS threshold FROM thresholds",
)
def threshold(spark, sf):
    return rounded(hourly_thresholds(written_hourly(spark, sf)))


@query(
    "a7_threshold_of_line_items",
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS threshold FROM lineitem GROUP BY 1",
)
def threshold_of_line_items(spark, sf):
    return rounded(quantile.exact_percentile(table(spark, sf, "lineitem"), "l_extendedprice", 0.95, ["l_returnflag"]), 4)


@query("a7_threshold_of_orders", "SELECT round(quantile_cont(o_totalprice, 0.95), 4) AS threshold FROM orders")
def threshold_of_orders(spark, sf):
    return rounded(quantile.exact_percentile(table(spark, sf, "orders"), "o_totalprice", 0.95), 4)


@query(
    "a8_daily_max",
    sql.ctes(sql.HOURLY)
    + "SELECT event_type, timestamp::DATE AS day, max(y) AS max_y FROM hourly GROUP BY 1, 2",
)
def daily_max(spark, sf):
    return metrics.daily_max(hourly(spark, sf), keys=_TYPE)


@query(
    "a9_hour_of_day_mean",
    sql.ctes(sql.HOURLY)
    + """SELECT event_type, hour(timestamp)::INTEGER AS hour, round(avg(y), 6) AS mean_y FROM hourly GROUP BY 1, 2""",
)
def hour_of_day_mean(spark, sf):
    return rounded(metrics.hour_of_day_mean(hourly(spark, sf), keys=_TYPE))


@query(
    "a10_target_stats",
    sql.ctes(sql.NATION_DAILY)
    + f"SELECT c_nationkey, min(y) AS min, max(y) AS max, {sql.lean('avg(y)', 4)} AS mean FROM nation_daily GROUP BY 1",
)
def target_stats(spark, sf):
    return rounded(metrics.target_stats(daily_by_nation(spark, sf), keys=["c_nationkey"]), 4, lean=sql.LEAN)


@query(
    "a11_split_shares",
    sql.ctes(sql.DATASET)
    + """SELECT s.split, count(d.split) AS row_count, round(count(d.split) * 100.0 / (SELECT count(*) FROM dataset), 6)
         AS percent FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN dataset d USING (split) GROUP BY 1""",
)
def split_shares(spark, sf):
    return rounded(metrics.split_shares(daily_dataset(spark, sf)))


_NULLABLE = ["timestamp", "temp_c", "dewpoint_c", "rel_hum_pct", "precip_mm"]


@query(
    "a12_null_rates",
    sql.ctes(sql.WEATHER)
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count(*) - count({c}) AS null_count,
            round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_rate, count({c}) = 0 AS all_null FROM weather"""
        for c in _NULLABLE
    ),
)
def null_rates(spark, sf):
    return rounded(metrics.null_rates(daily_weather(spark, sf).select(*_NULLABLE)))


@query(
    "a13_rows_with_nulls",
    sql.ctes(sql.WEATHER)
    + """SELECT count(*) AS row_count, count(CASE WHEN d OR p THEN 1 END) AS null_rows,
         round(count(CASE WHEN d OR p THEN 1 END) * 100.0 / count(*), 6) AS null_rows_pct,
         count(CASE WHEN d THEN 1 END) AS null_rows_without_precip_mm,
         round(count(CASE WHEN d THEN 1 END) * 100.0 / count(*), 6) AS null_rows_without_precip_mm_pct
         FROM (SELECT temp_c IS NULL OR dewpoint_c IS NULL OR rel_hum_pct IS NULL AS d, precip_mm IS NULL AS p
               FROM weather)""",
)
def rows_with_nulls(spark, sf):
    return rounded(metrics.rows_with_nulls(daily_weather(spark, sf)))


@query(
    "a14_coverage",
    sql.ctes(sql.NATION_DAILY)
    + """SELECT c_nationkey, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp,
         count(*) AS row_count FROM nation_daily GROUP BY 1""",
)
def coverage(spark, sf):
    return metrics.coverage(daily_by_nation(spark, sf), ["c_nationkey"])


@query(
    "a14_rows_per_year",
    sql.ctes(sql.NATION_DAILY)
    + "SELECT c_nationkey, year(timestamp)::INTEGER AS year, count(*) AS row_count FROM nation_daily GROUP BY 1, 2",
)
def rows_per_year(spark, sf):
    return metrics.rows_per_year(daily_by_nation(spark, sf), ["c_nationkey"])


_COMPLETENESS = """SELECT {key} y.year::INTEGER AS year, last_timestamp, coalesce(n, 0) AS row_count, expected_rows,
  round(coalesce(n, 0) * 100.0 / expected_rows, 6) AS coverage_pct,
  CASE WHEN n IS NULL THEN 'No data'
       WHEN last_timestamp < make_timestamp(y.year, 12, 31, 0, 0, 0.0) THEN 'PARTIAL'
       WHEN n < expected_rows THEN 'PARTIAL' ELSE 'Complete' END AS status FROM"""


@query(
    "a15_year_completeness",
    sql.ctes(sql.DAILY_FILLED)
    + _COMPLETENESS.format(key="")
    + """ (SELECT year, (make_date(year + 1, 1, 1) - make_date(year, 1, 1))::BIGINT AS expected_rows
       FROM generate_series(1994, 2002) t(year)) y
  LEFT JOIN (SELECT year(timestamp) AS year, max(timestamp) AS last_timestamp, count(*) AS n
             FROM daily_filled GROUP BY 1) s USING (year)""",
)
def year_completeness(spark, sf):
    filled = grid.regularise(daily(spark, sf), ["y"], freq="1 day")
    return rounded(metrics.year_completeness(filled, 1994, 2002, freq="1 day"))


@query(
    "a15_year_completeness_by_nation",
    sql.ctes(sql.NATION_DAILY)
    + _COMPLETENESS.format(key="c_nationkey,")
    + """ (SELECT c_nationkey, year, (make_date(year + 1, 1, 1) - make_date(year, 1, 1))::BIGINT AS expected_rows
       FROM generate_series(1994, 2002) t(year), (SELECT DISTINCT c_nationkey FROM nation_daily)) y
  LEFT JOIN (SELECT c_nationkey, year(timestamp) AS year, max(timestamp) AS last_timestamp, count(*) AS n
             FROM nation_daily GROUP BY 1, 2) s USING (c_nationkey, year)""",
)
def year_completeness_by_nation(spark, sf):
    done = metrics.year_completeness(daily_by_nation(spark, sf), 1994, 2002, ["c_nationkey"], freq="1 day")
    return rounded(done)


@query(
    "a16_missing_steps",
    sql.ctes(sql.HOURLY)
    + """SELECT event_type, count(*) AS observed_rows,
         (date_diff('hour', min(timestamp), max(timestamp)) + 1 - count(*))::BIGINT AS missing_steps
         FROM hourly GROUP BY 1""",
)
def missing_steps(spark, sf):
    return metrics.missing_steps(hourly(spark, sf), _TYPE, source=None)


@query(
    "a17_imputed_share",
    sql.ctes(sql.HOURLY_FILLED)
    + """SELECT event_type, count(*) AS row_count, count(CASE WHEN is_imputed THEN 1 END) AS flagged_rows,
         round(count(CASE WHEN is_imputed THEN 1 END) * 100.0 / count(*), 6) AS flagged_pct
         FROM hourly_filled GROUP BY 1""",
)
def imputed_share(spark, sf):
    return rounded(metrics.flag_share(hourly_filled(spark, sf), "is_imputed", _TYPE))


@query(
    "a18_source_count",
    "SELECT l_returnflag, count(DISTINCT l_suppkey) AS source_count FROM lineitem GROUP BY 1",
)
def source_count(spark, sf):
    return metrics.source_count(table(spark, sf, "lineitem"), ["l_returnflag"], "l_suppkey")


@query(
    "a19_observed_share",
    sql.ctes(sql.DEMAND, sql.WEATHER)
    + """SELECT count(w.dewpoint_c) AS observed, round(count(w.dewpoint_c) * 100.0 / count(*), 6) AS observed_pct
         FROM demand d LEFT JOIN weather w USING (timestamp)""",
)
def observed_share(spark, sf):
    days = daily_demand(spark, sf).select("timestamp")
    joined = days.join(daily_weather(spark, sf).select("timestamp", "dewpoint_c"), "timestamp", "left")
    return rounded(metrics.observed_share(joined, "dewpoint_c"))


@query(
    "a20_adder_profile",
    sql.ctes(sql.SEGMENTS)
    + """, adders AS (SELECT name AS scenario, round(start_mw * pow(1 + yoy_growth, year(o_orderdate) - 1995), 4) AS a
           FROM orders, segments)
       SELECT scenario, count(*) AS count, count(DISTINCT a) AS distinct_values, round(avg(a), 4) AS mean,
         round(stddev_samp(a), 4) AS std, min(a) AS min, round(quantile_cont(a, 0.25), 4) AS q25,
         round(quantile_cont(a, 0.5), 4) AS q50, round(quantile_cont(a, 0.75), 4) AS q75, max(a) AS max
       FROM adders GROUP BY 1""",
)
def adder_profile(spark, sf):
    forecast = table(spark, sf, "orders").select(
        F.col("o_orderkey"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("y_hat")
    )
    rows = scenarios.apply_scenarios(forecast, segment_scenarios(spark, sf), keys=["o_orderkey"])
    added = rounded(rows.where("scenario <> 'baseline'").select("scenario", "ai_adder_mw"), 4)
    return rounded(metrics.value_profile(added, "ai_adder_mw", ["scenario"]), 4)


@query(
    "a21_feature_scale",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def feature_scale(spark, sf):
    return rounded(metrics.feature_scale(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))

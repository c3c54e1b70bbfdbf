"""Joins."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.inputs import (
    daily_by_nation,
    daily_demand,
    daily_forecast,
    daily_weather,
    hourly,
    hourly_forecast,
    segment_scenarios,
    table,
    written_daily,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.operators import joins, scenarios
from tidewatt.operators.keyed import attach
from tidewatt.operators.metrics import hour_of_day_mean


@query(
    "j1_weather_onto_demand",
    sql.ctes(sql.DEMAND, sql.WEATHER)
    + """SELECT d.timestamp, round(d.ontario_demand_mw, 4) AS ontario_demand_mw, w.temp_c, w.dewpoint_c,
         w.rel_hum_pct, w.precip_mm, w.is_imputed_weather
         FROM demand d LEFT JOIN weather w USING (timestamp)""",
)
def weather_onto_demand(spark, sf):
    demand = daily_demand(spark, sf).select("timestamp", "ontario_demand_mw")
    return rounded(joins.with_weather(demand, daily_weather(spark, sf)), 4)


@query(
    "j1_weather_onto_many_series",
    sql.ctes(sql.NATION_DAILY, sql.WEATHER)
    + """SELECT d.c_nationkey, d.timestamp, d.y, w.temp_c FROM nation_daily d LEFT JOIN weather w USING (timestamp)""",
)
def weather_onto_many_series(spark, sf):
    weather = daily_weather(spark, sf).select("timestamp", "temp_c")
    return joins.with_weather(daily_by_nation(spark, sf), weather)


_TEMPLATE = """template AS (SELECT event_type, timestamp, y AS y_hat FROM hourly)"""
_LEAP_TEMPLATE = """template AS (SELECT timestamp, y AS y_hat FROM daily_filled WHERE year(timestamp) = {year})"""


def _synthetic_sql(year: int, step: str, keys: list[str]) -> str:
    cols = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    using = f"USING ({', '.join([*keys, 'source'])})"
    hours = f"LEFT JOIN hour_means h ON h.hour = hour(c.timestamp) {''.join(f'AND h.{k} = c.{k} ' for k in keys)}"
    return f"""series AS (SELECT {cols}min(year(timestamp)) AS ty FROM template {group}),
calendar AS (SELECT {cols}ty, unnest(generate_series(TIMESTAMP '{year}-01-01', TIMESTAMP '{year + 1}-01-01'
               - INTERVAL 1 {step}, INTERVAL 1 {step})) AS timestamp FROM series),
sourced AS (SELECT *, CASE WHEN month(timestamp) = 2 AND day(timestamp) = 29
               AND NOT ((ty % 4 = 0 AND ty % 100 <> 0) OR ty % 400 = 0)
             THEN make_timestamp(ty, 2, 28, hour(timestamp), minute(timestamp), 0.0)
             ELSE make_timestamp(ty, month(timestamp), day(timestamp), hour(timestamp), minute(timestamp), 0.0)
             END AS source FROM calendar),
hour_means AS (SELECT {cols}hour(timestamp) AS hour, avg(y_hat) AS mean FROM template GROUP BY ALL),
known AS (SELECT {cols}timestamp AS source, y_hat, true AS matched FROM template),
synthetic AS (
  SELECT {''.join(f'c.{k}, ' for k in keys)}c.timestamp,
         CASE WHEN k.matched THEN k.y_hat ELSE coalesce(h.mean, 0.0) END AS y_hat, true AS baseline_is_synthetic
  FROM sourced c LEFT JOIN known k {using} {hours})"""


@query(
    "j2_template_calendar_leap_to_common",
    sql.ctes(sql.DAILY_FILLED, _LEAP_TEMPLATE.format(year=2000), _synthetic_sql(2002, "DAY", []))
    + "SELECT timestamp, round(y_hat, 4) AS y_hat, baseline_is_synthetic FROM synthetic",
)
def template_leap_to_common(spark, sf):
    return rounded(scenarios.synthetic_year(_template(spark, sf, 2000), 2002, freq="1 day"), 4)


@query(
    "j2_template_calendar_common_to_leap",
    sql.ctes(sql.DAILY_FILLED, _LEAP_TEMPLATE.format(year=1999), _synthetic_sql(2004, "DAY", []))
    + "SELECT timestamp, round(y_hat, 4) AS y_hat, baseline_is_synthetic FROM synthetic",
)
def template_common_to_leap(spark, sf):
    return rounded(scenarios.synthetic_year(_template(spark, sf, 1999), 2004, freq="1 day"), 4)


def _template(spark, sf, year):
    return written_daily(spark, sf).where(F.year("timestamp") == year).select("timestamp", F.col("y").alias("y_hat"))


@query(
    "j3_hour_mean_fallback",
    sql.ctes(sql.HOURLY, _TEMPLATE, _synthetic_sql(2026, "HOUR", ["event_type"]))
    + "SELECT event_type, timestamp, round(y_hat, 6) AS y_hat, baseline_is_synthetic FROM synthetic",
)
def hour_mean_fallback(spark, sf):
    template = hourly(spark, sf).withColumnRenamed("y", "y_hat")
    return rounded(scenarios.synthetic_year(template, 2026, keys=["event_type"]))


@query(
    "j4_year_lookup",
    sql.ctes(sql.SEGMENTS)
    + """, years AS (SELECT name, unnest(generate_series(start_year, end_year)) AS year, start_year, start_mw, yoy_growth
              FROM segments),
         levels AS (SELECT name, year, start_mw * pow(1 + yoy_growth, year - start_year) AS mw FROM years)
       SELECT o_orderkey, round(mw, 4) AS ai_adder_mw FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN levels ON name = c_mktsegment AND levels.year = year(o_orderdate)""",
)
def year_lookup(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"))
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    yearly = scenarios.yearly_levels(segment_scenarios(spark, sf))
    added = scenarios.with_adder(orders, yearly, ts="o_orderdate", by=["name"])
    return rounded(added.select("o_orderkey", "ai_adder_mw"), 4)


@query(
    "j7_align_tables",
    sql.ctes(sql.HOURLY_FORECAST)
    + """SELECT a.event_type, a.timestamp, a.y, round(p.y_hat, 6) AS y_hat
         FROM hourly a JOIN hourly_forecast p USING (event_type, timestamp)""",
)
def align_tables(spark, sf):
    return rounded(joins.align_tables(hourly(spark, sf), hourly_forecast(spark, sf), keys=["event_type"]))


@query(
    "j8_restrict_to_aligned",
    sql.ctes(sql.HOURLY_FORECAST)
    + """SELECT a.event_type, a.timestamp, a.y FROM hourly a
         WHERE EXISTS (SELECT 1 FROM hourly_forecast p WHERE p.event_type = a.event_type
                       AND p.timestamp = a.timestamp AND p.y_hat > 100)""",
)
def restrict_to_aligned(spark, sf):
    kept = hourly_forecast(spark, sf).where("y_hat > 100")
    return joins.restricted_to(hourly(spark, sf), kept, keys=["event_type"])


@query(
    "j9_missing_days",
    sql.ctes(sql.DAILY, sql.WEATHER)
    + "SELECT w.timestamp FROM weather w WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.timestamp = w.timestamp)",
)
def missing_days(spark, sf):
    days = daily_weather(spark, sf).select("timestamp")
    return joins.missing_from(days, daily_demand(spark, sf).where("source_file <> 'IMPUTED'"), ["timestamp"])


@query(
    "j3_hour_of_day_join",
    sql.ctes(sql.HOURLY)
    + """, means AS (SELECT event_type, hour(timestamp) AS hour, avg(y) AS mean_y FROM hourly GROUP BY 1, 2)
       SELECT h.event_type, h.timestamp, round(h.y - m.mean_y, 6) + 0.0 AS off_mean FROM hourly h
       JOIN means m ON m.event_type = h.event_type AND m.hour = hour(h.timestamp)""",
)
def hour_of_day_join(spark, sf):
    series = hourly(spark, sf)
    means = hour_of_day_mean(series, keys=["event_type"])
    joined = attach(series.withColumn("hour", F.hour("timestamp")), means, ["event_type", "hour"], ["timestamp"])
    off = (F.col("y") - F.col("mean_y")).alias("off_mean")
    return rounded(joined.select("event_type", "timestamp", off))


@query(
    "j7_known_pairs",
    sql.ctes(sql.DAILY_FORECAST, sql.WEATHER)
    + """SELECT f.timestamp, round(f.y, 4) AS y, w.dewpoint_c AS y_hat FROM forecast f JOIN weather w USING (timestamp)
         WHERE w.dewpoint_c IS NOT NULL""",
)
def known_pairs(spark, sf):
    weather = daily_weather(spark, sf).select("timestamp", F.col("dewpoint_c").alias("y_hat"))
    pairs = daily_forecast(spark, sf).select("timestamp", "y").join(weather, "timestamp", "left")
    return rounded(joins.aligned(pairs), 4)

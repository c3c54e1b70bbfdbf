"""Regular grid, fills and imputation flags."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.inputs import (
    daily,
    daily_by_nation,
    daily_demand,
    daily_demand_raw,
    daily_weather,
    hourly,
    hourly_filled,
    hourly_with_holes,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.operators import grid
from tidewatt.plans.features import dry_where_unknown, weather_filled
from tidewatt.operators.joins import with_weather

_HOLES = sql.ctes(sql.HOURLY, sql.HOURLY_GRID)
_TYPE = ["event_type"]


@query("g1_complete_grid", _HOLES + "SELECT event_type, timestamp FROM hourly_grid")
def complete_grid(spark, sf):
    return grid.complete_grid(hourly(spark, sf), keys=_TYPE)


@query(
    "g1_complete_grid_one_series",
    sql.ctes(sql.DAILY, sql.on_grid("daily", "daily_grid", ["y"], unit="DAY")) + "SELECT timestamp FROM daily_grid",
)
def complete_grid_one_series(spark, sf):
    return grid.complete_grid(daily(spark, sf), freq="1 day")


@query(
    "g2_reindex",
    _HOLES
    + """SELECT event_type, timestamp, y, CASE WHEN is_new THEN 'IMPUTED' ELSE 'events' END AS source_file
         FROM hourly_grid""",
)
def reindex(spark, sf):
    return grid.reindex(hourly(spark, sf).withColumn("source_file", F.lit("events")), keys=_TYPE)


def _fill_sql(how: str) -> str:
    known = sql.filled("hourly_grid", "hourly_known", ["y"], _TYPE, how)
    return sql.ctes(sql.HOURLY, sql.HOURLY_GRID, known) + (
        f"SELECT event_type, timestamp, round(y_{how}, 6) + 0.0 AS y FROM hourly_known"
    )


@query("g3_interpolate", _fill_sql("interpolated"))
def interpolate(spark, sf):
    return rounded(grid.interpolate(hourly_with_holes(spark, sf), ["y"], keys=_TYPE))


@query("g4_forward_fill", _fill_sql("forward"))
def forward_fill(spark, sf):
    return rounded(grid.forward_fill(hourly_with_holes(spark, sf), ["y"], keys=_TYPE))


@query("g5_backward_fill", _fill_sql("backward"))
def backward_fill(spark, sf):
    return rounded(grid.backward_fill(hourly_with_holes(spark, sf), ["y"], keys=_TYPE))


@query(
    "g1_g2_g3_hourly_filled",
    sql.ctes(sql.HOURLY_FILLED) + "SELECT event_type, timestamp, round(y, 6) AS y, is_imputed FROM hourly_filled",
)
def hourly_table(spark, sf):
    return rounded(hourly_filled(spark, sf))


@query(
    "g1_g2_g3_nation_filled",
    sql.ctes(sql.NATION_FILLED) + "SELECT c_nationkey, timestamp, round(y, 4) AS y, is_imputed FROM nation_filled",
)
def nation_table(spark, sf):
    return rounded(grid.regularise(daily_by_nation(spark, sf), ["y"], keys=["c_nationkey"], freq="1 day"), 4)


@query(
    "g6_demand_imputed",
    sql.ctes(sql.DEMAND)
    + """SELECT timestamp, round(ontario_demand_mw, 4) AS ontario_demand_mw,
         round(market_demand_mw, 4) AS market_demand_mw, source_file, is_imputed FROM demand""",
)
def demand_imputed(spark, sf):
    return rounded(daily_demand(spark, sf), 4)


_WEATHER_KNOWN = sql.filled("weather_grid", "weather_known", ["temp_c", "dewpoint_c", "rel_hum_pct", "precip_mm"])


@query(
    "g7_weather_imputed",
    sql.ctes(
        sql.WEATHER,
        sql.on_grid("weather", "weather_grid", ["temp_c", "dewpoint_c", "rel_hum_pct", "precip_mm"], unit="DAY"),
        _WEATHER_KNOWN,
    )
    + """SELECT timestamp, round(temp_c_filled, 6) AS temp_c, round(dewpoint_c_filled, 6) AS dewpoint_c,
         round(rel_hum_pct_filled, 6) AS rel_hum_pct, round(precip_mm_filled, 6) AS precip_mm,
         is_new OR temp_c IS NULL AS is_imputed_weather FROM weather_known""",
)
def weather_imputed(spark, sf):
    raw = daily_weather(spark, sf).drop("is_imputed_weather")
    return rounded(
        grid.regularise(
            raw,
            ["temp_c", "dewpoint_c", "rel_hum_pct", "precip_mm"],
            freq="1 day",
            flag="is_imputed_weather",
            flag_columns=["temp_c"],
        )
    )


@query(
    "g8_g9_weather_after_join",
    sql.ctes(
        sql.DEMAND,
        sql.WEATHER,
        """joined AS (SELECT d.timestamp, w.* EXCLUDE (timestamp, precip_mm),
           coalesce(w.precip_mm, 0.0) AS precip_mm FROM demand d LEFT JOIN weather w USING (timestamp))""",
        sql.filled("joined", "wx", ["temp_c", "dewpoint_c", "rel_hum_pct"]),
    )
    + """SELECT timestamp, round(temp_c_filled, 6) AS temp_c, round(dewpoint_c_filled, 6) AS dewpoint_c,
         round(rel_hum_pct_filled, 6) AS rel_hum_pct, precip_mm,
         temp_c IS NULL OR coalesce(is_imputed_weather, false) AS weather_was_missing FROM wx""",
)
def weather_after_join(spark, sf):
    joined = dry_where_unknown(with_weather(daily_demand(spark, sf).select("timestamp"), daily_weather(spark, sf)))
    return rounded(weather_filled(joined, freq="1 day").drop("is_imputed_weather"))


@query(
    "g6_flag_counts",
    sql.ctes(sql.DEMAND)
    + """SELECT source_file, is_imputed, count(*) AS row_count FROM demand GROUP BY 1, 2""",
)
def flag_counts(spark, sf):
    filled = grid.regularise(
        daily_demand_raw(spark, sf), ["ontario_demand_mw", "market_demand_mw"], freq="1 day", source="source_file"
    )
    return filled.groupBy("source_file", "is_imputed").agg(F.count("*").alias("row_count"))

"""Lags, rolling means, differences, maxima, duplicates; sorted results and limits; set operations."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.inputs import (
    daily_by_nation,
    daily_weather,
    hourly,
    hourly_filled,
    table,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.functions.timeline import floor_to
from tidewatt.operators import metrics, windows

_TYPE = ["event_type"]
_PART = "(PARTITION BY event_type ORDER BY timestamp"


@query(
    "w1_lags",
    sql.ctes(sql.HOURLY_FILLED)
    + f"""SELECT event_type, timestamp, round(lag(y, 1) OVER {_PART}), 6) AS demand_lag_1h,
      round(lag(y, 24) OVER {_PART}), 6) AS demand_lag_24h, round(lag(y, 168) OVER {_PART}), 6) AS demand_lag_168h
      FROM hourly_filled""",
)
def lags(spark, sf):
    done = windows.with_lags_and_means(hourly_filled(spark, sf), "y", means={}, keys=_TYPE)
    return rounded(done.drop("y", "is_imputed"))


@query(
    "w2_rolling_means",
    sql.ctes(sql.HOURLY_FILLED)
    + f"""SELECT event_type, timestamp,
      floor(avg(y) OVER {_PART} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) * 1e6 + 0.5001) / 1e6
        AS demand_rollmean_24h,
      floor(avg(y) OVER {_PART} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) * 1e6 + 0.5001) / 1e6
        AS demand_rollmean_168h
      FROM hourly_filled""",
)
def rolling_means(spark, sf):
    done = windows.with_lags_and_means(hourly_filled(spark, sf), "y", lags={}, keys=_TYPE)
    return rounded(done.drop("y", "is_imputed"), lean=1e-4)


@query(
    "w3_time_differences",
    sql.ctes(sql.HOURLY)
    + f"""SELECT event_type, timestamp, (date_diff('second', lag(timestamp) OVER {_PART}), timestamp))::DOUBLE
      AS gap_seconds FROM hourly""",
)
def time_differences(spark, sf):
    return windows.with_previous_time(hourly(spark, sf).drop("y"), keys=_TYPE)


@query(
    "w3_time_differences_of_events",
    """SELECT event_type, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)))
       / 1000000.0, 6) AS gap_seconds, ts FROM events""",
)
def time_differences_of_events(spark, sf):
    events = table(spark, sf, "events").select("event_type", "ts")
    return rounded(windows.with_previous_time(events, "ts", _TYPE, "1 second"))


@query(
    "w4_first_maximum",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (
         PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r
       FROM lineitem) WHERE r = 1""",
)
def first_maximum(spark, sf):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    items = table(spark, sf, "lineitem")
    return windows.first_maximum(items, "l_quantity", order, ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query(
    "w5_duplicate_times",
    """SELECT o_custkey, o_orderdate, count(*) AS row_count FROM orders GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_times(spark, sf):
    return windows.duplicate_times(table(spark, sf, "orders"), "o_orderdate", ["o_custkey"])


@query(
    "o1_sorted_series",
    sql.ctes(sql.NATION_DAILY)
    + "SELECT c_nationkey, timestamp, y FROM nation_daily ORDER BY c_nationkey, timestamp",
)
def sorted_series(spark, sf):
    return daily_by_nation(spark, sf).orderBy("c_nationkey", "timestamp")


@query(
    "o3_worst_null_rates",
    sql.ctes(sql.WEATHER)
    + """SELECT * FROM (
      SELECT 'dewpoint_c' AS column, count(*) - count(dewpoint_c) AS null_count,
        round((count(*) - count(dewpoint_c))::DOUBLE / count(*), 6) AS null_rate, count(dewpoint_c) = 0 AS all_null
      FROM weather UNION ALL
      SELECT 'precip_mm', count(*) - count(precip_mm),
        round((count(*) - count(precip_mm))::DOUBLE / count(*), 6), count(precip_mm) = 0 FROM weather)
      WHERE null_rate > 0 ORDER BY null_rate DESC, "column" LIMIT 10""",
)
def worst_null_rates(spark, sf):
    return rounded(metrics.worst_null_rates(daily_weather(spark, sf)))


@query(
    "o4_duplicate_examples",
    """SELECT o_custkey, o_orderdate, count(*) AS row_count FROM orders GROUP BY 1, 2 HAVING count(*) > 1
       ORDER BY o_custkey, o_orderdate LIMIT 5""",
)
def duplicate_examples(spark, sf):
    found = windows.duplicate_times(table(spark, sf, "orders"), "o_orderdate", ["o_custkey"])
    return found.orderBy("o_custkey", "o_orderdate").limit(5)


@query(
    "u1_union_of_sources",
    """SELECT o_orderdate AS timestamp, o_totalprice AS y, 'orders' AS source_file FROM orders
       UNION ALL SELECT l_shipdate, l_extendedprice, 'lineitem' FROM lineitem
       UNION ALL SELECT ts, value, 'events' FROM events""",
)
def union_of_sources(spark, sf):
    parts = {"orders": ("o_orderdate", "o_totalprice"), "lineitem": ("l_shipdate", "l_extendedprice"), "events": ("ts", "value")}
    frames = [
        table(spark, sf, name).select(
            F.col(value).alias("y"), F.lit(name).alias("source_file"), F.col(at).alias("timestamp")
        )
        for name, (at, value) in parts.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _days(spark, sf, name, at):
    return table(spark, sf, name).select(floor_to(at, "1 day").alias("timestamp"))


@query(
    "u5_days_without_orders",
    """SELECT DISTINCT date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp FROM lineitem
       EXCEPT SELECT date_trunc('day', o_orderdate)::TIMESTAMP FROM orders""",
)
def days_without_orders(spark, sf):
    return _days(spark, sf, "lineitem", "l_shipdate").subtract(_days(spark, sf, "orders", "o_orderdate"))


@query(
    "u5_common_days",
    """SELECT DISTINCT date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp FROM lineitem
       INTERSECT SELECT date_trunc('day', o_orderdate)::TIMESTAMP FROM orders""",
)
def common_days(spark, sf):
    return _days(spark, sf, "lineitem", "l_shipdate").intersect(_days(spark, sf, "orders", "o_orderdate"))

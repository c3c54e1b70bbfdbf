"""Data-quality rules."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.inputs import (
    DAILY,
    daily_by_nation,
    daily_dataset,
    daily_demand,
    daily_demand_raw,
    daily_weather,
    hourly,
    segment_scenarios,
    table,
    written_hourly,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.functions.timeline import floor_to
from tidewatt.operators import contracts, scenarios
from tidewatt.operators.windows import duplicate_times
from tidewatt.plans.features import dataset_findings

_TYPE = ["event_type"]


@query(
    "q1_required_columns",
    sql.ctes(sql.DEMAND) + "SELECT count(*) AS row_count FROM demand",
)
def required_columns(spark, sf):
    demand = contracts.require_columns(daily_demand(spark, sf), contracts.DEMAND_COLUMNS, "demand")
    return demand.agg(F.count("*").alias("row_count"))


@query(
    "q2_unique_times",
    """SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS timestamp, count(*) AS row_count
       FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def unique_times(spark, sf):
    rows = table(spark, sf, "events").select("user_id", floor_to("ts", "1 hour").alias("timestamp"))
    return duplicate_times(rows, keys=["user_id"])


@query(
    "q3_gaps",
    sql.ctes(sql.HOURLY)
    + """SELECT event_type, timestamp, gap_seconds, CASE WHEN gap_seconds > 3600 THEN 'gap' ELSE 'overlap' END AS kind
      FROM (SELECT *, (date_diff('second', lag(timestamp) OVER (PARTITION BY event_type ORDER BY timestamp),
                                 timestamp))::DOUBLE AS gap_seconds FROM hourly)
      WHERE abs(gap_seconds - 3600) > 1""",
)
def gaps(spark, sf):
    return contracts.gaps(hourly(spark, sf), keys=_TYPE)


@query(
    "q3_gaps_and_overlaps_of_orders",
    """SELECT o_orderdate, gap_seconds, CASE WHEN gap_seconds > 86400 THEN 'gap' ELSE 'overlap' END AS kind
      FROM (SELECT o_orderdate, (date_diff('second', lag(o_orderdate) OVER (ORDER BY o_orderdate), o_orderdate))::DOUBLE
            AS gap_seconds FROM orders) WHERE abs(gap_seconds - 86400) > 1""",
)
def gaps_and_overlaps_of_orders(spark, sf):
    return contracts.gaps(table(spark, sf, "orders").select("o_orderdate"), "o_orderdate", freq="1 day")


@query(
    "q3_off_grid_rows",
    """SELECT event_id, ts FROM events WHERE date_trunc('hour', ts) <> ts""",
)
def off_grid_rows(spark, sf):
    return contracts.off_grid(table(spark, sf, "events").select("event_id", "ts"), "ts")


@query(
    "q4_target_null",
    sql.ctes(sql.DEMAND_RAW) + "SELECT timestamp, ontario_demand_mw FROM demand_raw WHERE market_demand_mw IS NULL",
)
def target_null(spark, sf):
    return contracts.nulls_in(daily_demand_raw(spark, sf), "market_demand_mw").select("timestamp", "ontario_demand_mw")


@query(
    "q5_hour_range",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER AS "Hour" FROM lineitem
       WHERE l_quantity < 1 OR l_quantity > 24""",
)
def hour_range(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("Hour")
    )
    return contracts.bad_hours(rows)


@query(
    "q6_never_observed",
    """SELECT o_custkey, 0::BIGINT AS observed FROM orders GROUP BY 1
       HAVING count(CASE WHEN o_orderstatus = 'P' THEN 1 END) = 0""",
)
def never_observed(spark, sf):
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("temp_c")
    return contracts.never_observed(table(spark, sf, "orders").select("o_custkey", pending), keys=["o_custkey"])


@query(
    "q7_all_null_columns",
    sql.ctes(sql.WEATHER)
    + "SELECT 'wind_spd_kmh' AS column FROM weather HAVING count(*) > 0",
)
def all_null_columns(spark, sf):
    return contracts.all_null_columns(daily_weather(spark, sf).withColumn("wind_spd_kmh", F.lit(None).cast("double")))


@query(
    "q8_split_labels",
    sql.ctes(sql.DATASET)
    + """SELECT rule FROM (SELECT
        count(CASE WHEN split NOT IN ('train', 'val', 'test') THEN 1 END) > 0 AS a,
        count(CASE WHEN split = 'train' AND year IN (1994, 2003) THEN 1 END) = 0 AS b,
        count(CASE WHEN split = 'val' AND year = 1999 THEN 1 END) = 0 AS c,
        count(CASE WHEN year = 2000 THEN 1 END) > 0
          AND count(CASE WHEN split = 'test' AND year = 2000 THEN 1 END) = 0 AS d FROM dataset),
      (VALUES (1, 'invalid split label'), (2, 'train split misses its years'),
              (3, 'val split misses its year'), (4, 'test split misses its year')) r(i, rule)
      WHERE (i = 1 AND a) OR (i = 2 AND b) OR (i = 3 AND c) OR (i = 4 AND d)""",
)
def split_labels(spark, sf):
    """Against expectations that the data does not meet, so that there is something to find."""
    return contracts.split_labels(daily_dataset(spark, sf), [1994, 2003], 1999, 2000)


@query(
    "q8_split_labels_pass",
    sql.ctes(sql.DATASET)
    + """SELECT 'invalid split label' AS rule FROM dataset WHERE split NOT IN ('train', 'val', 'test') GROUP BY 1""",
)
def split_labels_pass(spark, sf):
    return contracts.split_labels(daily_dataset(spark, sf), [1995, 1996, 1997, 1998, 1999], 2000, 2001)


@query(
    "q9_missing_years",
    """SELECT y::INTEGER AS year FROM generate_series(1990, 2005) t(y)
       WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)""",
)
def missing_years(spark, sf):
    return contracts.missing_years(table(spark, sf, "orders"), 1990, 2005, "o_orderdate")


@query(
    "q11_short_years",
    sql.ctes(sql.NATION_DAILY)
    + """SELECT c_nationkey, year(timestamp)::INTEGER AS year, count(*) AS row_count FROM nation_daily
         WHERE year(timestamp) = 2001 GROUP BY 1, 2 HAVING count(*) < 365""",
)
def short_years(spark, sf):
    return contracts.short_years(daily_by_nation(spark, sf), 2001, 365, ["c_nationkey"])


@query(
    "q11_small_test_split",
    sql.ctes(sql.DATASET)
    + """SELECT 'test' AS split, count(CASE WHEN split = 'test' THEN 1 END) AS row_count,
         round(count(CASE WHEN split = 'test' THEN 1 END) * 100.0 / count(*), 6) AS percent FROM dataset
         HAVING count(CASE WHEN split = 'test' THEN 1 END) < 8000""",
)
def small_test_split(spark, sf):
    return rounded(contracts.small_split(daily_dataset(spark, sf)))


_AT = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.000')"


def _rule_sql(rule: str, severity: str, rows: str) -> str:
    """Count and first five examples of the rows (example, n) that violate a rule."""
    return f"""SELECT '{rule}' AS rule, '{severity}' AS severity, coalesce(sum(n), 0)::BIGINT AS violations,
        coalesce(array_to_string(list(example ORDER BY example)[1:5], chr(10)), '') AS examples
        FROM (SELECT example, n FROM ({rows}) AS found, range(least(n, 5)) AS copies(i))"""


def _json_sql(key: str, *rest: str) -> str:
    """A violation as JSON text: the series, its time, and further members."""
    series = f"""'"{key}":"' || {key} || '",' || """ if key else ""
    return f"""'{{' || {series}'"timestamp":"' || {_AT} || '"' || {''.join(f"',{m}' || " for m in rest)}'}}'"""


def _report_sql(source: str, value: str, key: str = "", step: int = 3600) -> str:
    """Duplicate times, steps of the wrong length and unknown values of a table."""
    part = f"PARTITION BY {key} " if key else ""
    group = f"{key}, timestamp" if key else "timestamp"
    twice = _json_sql(key, """"row_count":' || row_count || '""")
    apart = _json_sql(key, """"gap_seconds":' || gap::DOUBLE || '""", """"kind":"' || CASE WHEN gap > {} THEN 'gap' ELSE 'overlap' END || '\"""".format(step))
    rules = [
        _rule_sql("unique_timestamp", "error", f"SELECT {twice} AS example, 1 AS n FROM (SELECT {group}, count(*) AS row_count FROM {source} GROUP BY {group} HAVING count(*) > 1)"),
        _rule_sql(
            "continuous",
            "error",
            f"""SELECT {apart} AS example, 1 AS n FROM (SELECT *, date_diff('second', lag(timestamp) OVER ({part}ORDER BY timestamp), timestamp) AS gap
            FROM {source}) WHERE abs(gap - {step}) > 1""",
        ),
        _rule_sql("target_not_null", "error", f"SELECT {_json_sql(key)} AS example, 1 AS n FROM {source} WHERE {value} IS NULL"),
    ]
    return " UNION ALL ".join(rules)


def _told(found):
    """The report with its examples in one text, a line each."""
    return found.withColumn("examples", F.concat_ws("\n", "examples"))


_SHORT_SQL = _rule_sql(
    "full_year",
    "warning",
    """SELECT '{"event_type":"' || event_type || '","year":2024,"row_count":' || count(*) || '}' AS example, 1 AS n
       FROM hourly WHERE year(timestamp) = 2024 GROUP BY event_type HAVING count(*) < 8760""",
)


@query("q12_series_report", sql.ctes(sql.HOURLY) + _report_sql("hourly", "y", "event_type") + " UNION ALL " + _SHORT_SQL)
def series_report(spark, sf):
    return _told(contracts.series_rules(hourly(spark, sf), ["timestamp", "y"], "y", keys=_TYPE, partial_year=2024))


@query("q12_filled_series_passes", sql.ctes(sql.HOURLY_FILLED) + _report_sql("hourly_filled", "y", "event_type"))
def filled_series_passes(spark, sf):
    return _told(contracts.series_rules(written_hourly(spark, sf), ["timestamp", "y"], "y", keys=_TYPE))


@query(
    "q12_raw_demand_report",
    sql.ctes(sql.DEMAND_RAW) + _report_sql("demand_raw", "market_demand_mw", step=86_400),
)
def raw_demand_report(spark, sf):
    return _told(contracts.series_rules(daily_demand_raw(spark, sf), ["timestamp"], "market_demand_mw", freq="1 day"))


_TWICE = _json_sql("", """"row_count":' || row_count || '""")


@query(
    "q12_dataset_inputs",
    sql.ctes(sql.DEMAND_RAW, sql.WEATHER)
    + " UNION ALL ".join(
        [
            *[
                _rule_sql(f"unique_{t}", "error", f"SELECT {_TWICE} AS example, 1 AS n FROM (SELECT timestamp, count(*) AS row_count FROM {source} GROUP BY 1 HAVING count(*) > 1)")
                for t, source in (("demand", "demand_raw"), ("weather", "weather"))
            ],
            _rule_sql("target_not_null", "error", f"SELECT {_json_sql('')} AS example, 1 AS n FROM demand_raw WHERE ontario_demand_mw IS NULL"),
        ]
    ),
)
def dataset_inputs(spark, sf):
    return _told(dataset_findings(daily_demand_raw(spark, sf), daily_weather(spark, sf), DAILY))


@query(
    "q13_scenario_findings",
    sql.ctes(sql.SEGMENTS)
    + """, span AS (SELECT max(year(l_shipdate)) AS last, min(year(l_shipdate)) AS first FROM lineitem)
      SELECT name || ' late' AS scenario, 'forecast year without level' AS rule FROM segments, span
        WHERE 1996 > first AND NOT (2001 < first OR 1996 > last)
      UNION ALL SELECT name || ' apart', 'no overlap with forecast' FROM segments
      UNION ALL SELECT name || ' empty', 'required key missing' FROM segments
      UNION ALL SELECT name || ' nothing', 'adds nothing' FROM segments""",
)
def scenario_findings(spark, sf):
    """Each segment's scenario as it is, and spoilt in the four ways that the rules find."""
    good = segment_scenarios(spark, sf)

    def spoilt(how, **changes):
        return good.withColumns({"name": F.concat("name", F.lit(f" {how}")), **changes})

    listed = good.unionByName(spoilt("late", start_year=F.lit(1996)))
    listed = listed.unionByName(spoilt("apart", start_year=F.lit(2050), end_year=F.lit(2051)))
    listed = listed.unionByName(spoilt("empty", yoy_growth=F.lit(None).cast("double")))
    listed = listed.unionByName(spoilt("nothing", start_mw=F.lit(0.0)))
    shipped = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("timestamp"))
    return scenarios.scenario_findings(listed, shipped)


@query(
    "c3d_unknown_ramps",
    sql.ctes(sql.SEGMENTS) + "SELECT name AS scenario, 'unknown ramp' AS rule FROM segments WHERE length(name) % 4 IN (1, 2)",
)
def unknown_ramps(spark, sf):
    """Scenarios whose ramp follows from the length of their name: a known one, a misspelt one, none, or another known one."""
    ramps = F.array(F.lit("flat"), F.lit("step_yearly"), F.lit(None).cast("string"), F.lit("step_quarterly"))
    listed = segment_scenarios(spark, sf).withColumn("ramp", F.get(ramps, F.length("name") % 4))
    return scenarios.unknown_ramps(listed)

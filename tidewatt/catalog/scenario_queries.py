"""Scenario levels, ramps, strain and the flagship query."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.aggregates import _THRESHOLDS, daily_threshold, hourly_thresholds
from tidewatt.catalog.inputs import (
    DAY_TRAIN_END,
    daily_forecast,
    segment_scenarios,
    table,
    written_daily,
    written_hourly,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.operators import scenarios
from tidewatt.plans import scenario_run

# Scenarios scaled to the driver tables.
HOURLY_SCENARIOS = [
    {"name": "low", "start_year": 2024, "end_year": 2025, "start_mw": 20.0, "yoy_growth": 0.05},
    {"name": "base", "start_year": 2024, "end_year": 2025, "start_mw": 35.0, "yoy_growth": 0.07},
    {"name": "high", "start_year": 2024, "end_year": 2025, "start_mw": 80.0, "yoy_growth": 0.15},
]
DAILY_SCENARIOS = [
    {"name": "low", "start_mw": 100_000.0, "yoy_growth": 0.05},
    {"name": "base", "start_year": 1994, "end_year": 2001, "start_mw": 175_000.0, "yoy_growth": 0.07},
    {"name": "shrinking", "start_year": 1995, "end_year": 2002, "start_mw": 400_000.0, "yoy_growth": -0.15},
]
_NAMES = ["baseline", "low", "base", "shrinking"]


def _rows(listed, first, last) -> str:
    return ", ".join(
        f"('{s['name']}', {s.get('start_year', first)}, {s.get('end_year', last)}, "
        f"{s['start_mw']}::DOUBLE, {s['yoy_growth']}::DOUBLE)"
        for s in listed
    )


def _level(shift: str) -> str:
    return f"start_mw * pow(1 + yoy_growth, year(timestamp) - start_year{shift})"


def _adder(shape: str) -> str:
    rise = f"(CASE WHEN year(timestamp) < end_year THEN {_level(' + 1')} ELSE {_level('')} END - {_level('')})"
    if shape == "flat":
        return _level("")
    if shape == "step_quarterly":
        return f"{_level('')} + {rise} * ((quarter(timestamp) - 1) / 3.0::DOUBLE)"
    begin = "make_timestamp(year(timestamp), 1, 1, 0, 0, 0.0)"
    until = "make_timestamp(year(timestamp) + 1, 1, 1, 0, 0, 0.0)"
    hours = f"(epoch_us(timestamp) - epoch_us({begin})) / 3600000000.0::DOUBLE"
    return f"{_level('')} + {rise} * ({hours} / ((epoch_us({until}) - epoch_us({begin})) / 3600000000.0::DOUBLE - 1))"


def _long(source: str, listed: str, shape: str, keys: str = "", kept: str = "") -> str:
    return f"""long AS (
  SELECT {keys}timestamp, {kept}'baseline' AS scenario, y_hat, 0.0::DOUBLE AS ai_adder_mw FROM {source}
  UNION ALL SELECT {keys}timestamp, {kept}name, y_hat, {_adder(shape)} FROM {source}, {listed})"""


_DAILY_LIST = f"(VALUES {_rows(DAILY_SCENARIOS, 1995, 2001)}) s(name, start_year, end_year, start_mw, yoy_growth)"
_HOURLY_LIST = f"(VALUES {_rows(HOURLY_SCENARIOS, 2024, 2024)}) s(name, start_year, end_year, start_mw, yoy_growth)"
_STRAIN = """SELECT {keys} year(timestamp)::INTEGER AS year, quarter(timestamp)::INTEGER AS quarter, scenario,
  round(max(y_hat + ai_adder_mw), {d}) AS predicted_peak_mw,
  count(CASE WHEN y_hat + ai_adder_mw > threshold THEN 1 END) AS predicted_high_hours,
  round(max(threshold), {d}) AS threshold_used,
  round(max(y_hat + ai_adder_mw) - max(y_hat), {d}) + 0.0 AS peak_delta_mw,
  count(CASE WHEN y_hat + ai_adder_mw > threshold THEN 1 END) - count(CASE WHEN y_hat > threshold THEN 1 END)
    AS high_hours_delta FROM {source} GROUP BY ALL"""


@query(
    "c1_yearly_levels",
    sql.ctes(sql.SEGMENTS)
    + """SELECT name, year::INTEGER AS year, round(start_mw * pow(1 + yoy_growth, year - start_year), 4) AS mw
         FROM (SELECT *, unnest(generate_series(start_year, end_year)) AS year FROM segments)""",
)
def yearly_levels(spark, sf):
    return rounded(scenarios.yearly_levels(segment_scenarios(spark, sf)), 4)


@query(
    "c2_default_scenarios",
    """SELECT event_id, date_add(ts, INTERVAL 2 YEAR) AS timestamp, scenario, round(value, 6) AS y_hat, mw AS ai_adder_mw,
         round(value + mw, 6) AS y_hat_with_ai FROM events,
         (VALUES ('baseline', 0.0::DOUBLE), ('low', 200.0), ('base', 350.0), ('high', 800.0)) s(scenario, mw)""",
)
def default_scenarios(spark, sf):
    """The default scenarios on events moved to 2026."""
    later = F.expr("ts + interval 2 years").alias("timestamp")
    forecast = table(spark, sf, "events").select("event_id", later, F.col("value").alias("y_hat"))
    return rounded(scenarios.apply_scenarios(forecast, scenarios.DEFAULT_SCENARIOS, keys=["event_id"]))


def _ramp_query(shape: str):
    def build(spark, sf):
        forecast = daily_forecast(spark, sf).select("timestamp", "y_hat")
        return rounded(scenarios.apply_scenarios(forecast, DAILY_SCENARIOS, shape), 4)

    return build


for _shape, _name in (
    ("flat", "c3a_c4_flat"),
    ("linear_within_year", "c3b_c4_linear_within_year"),
    ("step_quarterly", "c3c_c4_step_quarterly"),
):
    query(
        _name,
        sql.ctes(sql.DAILY_FORECAST, _long("forecast", _DAILY_LIST, _shape))
        + """SELECT timestamp, scenario, round(y_hat, 4) AS y_hat, round(ai_adder_mw, 4) AS ai_adder_mw,
             round(y_hat + ai_adder_mw, 4) AS y_hat_with_ai FROM long""",
    )(_ramp_query(_shape))


@query(
    "c3_hourly_linear_ramp",
    sql.ctes(
        """forecast AS (SELECT event_id, ts AS timestamp, value AS y_hat FROM events)""",
        _long("forecast", _HOURLY_LIST, "linear_within_year", "event_id, "),
    )
    + """SELECT event_id, timestamp, scenario, y_hat, round(ai_adder_mw, 6) AS ai_adder_mw,
         round(y_hat + ai_adder_mw, 6) AS y_hat_with_ai FROM long""",
)
def hourly_linear_ramp(spark, sf):
    forecast = table(spark, sf, "events").select("event_id", F.col("ts").alias("timestamp"), F.col("value").alias("y_hat"))
    return rounded(
        scenarios.apply_scenarios(forecast, HOURLY_SCENARIOS, "linear_within_year", keys=["event_id"])
    )


@query(
    "j5_c4_scenario_table",
    sql.ctes(sql.SEGMENTS, sql.DAILY_FORECAST, _long("forecast", "segments", "step_quarterly"))
    + """SELECT timestamp, scenario, round(y_hat, 4) AS y_hat, round(ai_adder_mw, 4) AS ai_adder_mw,
         round(y_hat + ai_adder_mw, 4) AS y_hat_with_ai FROM long""",
)
def scenario_table(spark, sf):
    forecast = daily_forecast(spark, sf).select("timestamp", "y_hat")
    return rounded(scenarios.apply_scenarios(forecast, segment_scenarios(spark, sf), "step_quarterly"), 4)


_DAILY_LIMIT = f"""t AS (SELECT quantile_cont(y, 0.95) AS threshold FROM daily_filled
  WHERE timestamp <= TIMESTAMP '{DAY_TRAIN_END}')"""


def daily_strain(spark, sf):
    filled = written_daily(spark, sf)
    forecast = daily_forecast(spark, sf, filled).select("timestamp", "y_hat")
    return scenario_run.strain_under_scenarios(
        forecast, daily_threshold(filled), DAILY_SCENARIOS, years=(1995, 2001)
    )


_DAILY_STRAIN = sql.ctes(sql.DAILY_FORECAST, _DAILY_LIMIT, _long("forecast", _DAILY_LIST, "flat"))


@query("c5_scenario_strain", _DAILY_STRAIN + _STRAIN.format(keys="", d=4, source="long, t"))
def scenario_strain(spark, sf):
    return rounded(daily_strain(spark, sf), 4)


@query(
    "c6_baseline_strain",
    _DAILY_STRAIN + f"SELECT * FROM ({_STRAIN.format(keys='', d=4, source='long, t')}) WHERE scenario = 'baseline'",
)
def baseline_strain(spark, sf):
    return rounded(scenarios.baseline_strain(daily_strain(spark, sf)), 4)


@query(
    "j6_strain_against_baseline",
    _DAILY_STRAIN
    + f""", strain AS ({_STRAIN.format(keys='', d=4, source='long, t')})
    SELECT a.year, a.quarter, a.scenario, a.predicted_peak_mw, a.predicted_high_hours, a.threshold_used,
      round(a.predicted_peak_mw - coalesce(b.predicted_peak_mw, 0.0), 4) + 0.0 AS peak_delta_mw,
      a.predicted_high_hours - coalesce(b.predicted_high_hours, 0) AS high_hours_delta
    FROM strain a LEFT JOIN strain b ON b.scenario = 'baseline' AND a.year = b.year AND a.quarter = b.quarter
      AND b.year < 2001""",
)
def strain_against_baseline(spark, sf):
    strain = rounded(daily_strain(spark, sf), 4)
    base = scenarios.baseline_strain(strain).where("year < 2001")
    return rounded(scenarios.against_baseline(strain, base), 4)


@query(
    "c8_season_summary",
    _DAILY_STRAIN
    + f""", strain AS ({_STRAIN.format(keys='', d=4, source='long, t')})
    SELECT *, CASE WHEN scenario = 'baseline' THEN 0 ELSE 1 END::INTEGER AS place,
      year || 'Q' || quarter AS quarter_label,
      CASE WHEN scenario = 'baseline' THEN '' ELSE (CASE WHEN peak_delta_mw >= 0 THEN '+' ELSE '' END)
        || round(peak_delta_mw)::BIGINT END AS peak_change,
      CASE WHEN scenario = 'baseline' THEN '' ELSE (CASE WHEN high_hours_delta >= 0 THEN '+' ELSE '' END)
        || high_hours_delta END AS high_hours_change FROM strain WHERE quarter IN (1, 3)""",
)
def season_summary(spark, sf):
    return scenarios.season_summary(rounded(daily_strain(spark, sf), 4))


@query(
    "c5_hourly_strain_by_type",
    sql.ctes(
        sql.HOURLY_FILLED,
        _THRESHOLDS,
        """forecast AS (SELECT event_type, timestamp, y AS y_hat, threshold
           FROM hourly_filled JOIN thresholds USING (event_type))""",
        _long("forecast", _HOURLY_LIST, "flat", "event_type, ", "threshold, "),
    )
    + _STRAIN.format(keys="event_type,", d=6, source="long"),
)
def flagship(spark, sf):
    """Peak and high-demand hours per series and scenario, from raw events.

    The filled hours are written once; threshold and strain read them.
    """
    filled = written_hourly(spark, sf)
    forecast = filled.select("event_type", "timestamp", F.col("y").alias("y_hat"))
    strain = scenario_run.strain_under_scenarios(
        forecast, hourly_thresholds(filled), HOURLY_SCENARIOS, keys=["event_type"], years=(2024, 2024)
    )
    return rounded(strain)


@query(
    "c7_synthetic_then_strain",
    sql.ctes(
        sql.DAILY_FILLED,
        "template AS (SELECT timestamp, y AS y_hat FROM daily_filled WHERE year(timestamp) = 1999)",
        """forecast AS (SELECT d::TIMESTAMP AS timestamp, t.y_hat
           FROM generate_series(TIMESTAMP '2004-01-01', TIMESTAMP '2004-12-31', INTERVAL 1 DAY) g(d)
           LEFT JOIN template t ON t.timestamp = make_timestamp(1999, month(d), CASE WHEN month(d) = 2
             AND day(d) = 29 THEN 28 ELSE day(d) END, 0, 0, 0.0))""",
        _DAILY_LIMIT,
        f"listed AS (SELECT * FROM (VALUES ('more', 2004, 2004, 200000.0::DOUBLE, 0.1::DOUBLE)) "
        "s(name, start_year, end_year, start_mw, yoy_growth))",
        _long("forecast", "listed", "flat"),
    )
    + _STRAIN.format(keys="", d=4, source="long, t"),
)
def synthetic_then_strain(spark, sf):
    filled = written_daily(spark, sf)
    template = filled.where(F.year("timestamp") == 1999).select("timestamp", F.col("y").alias("y_hat"))
    baseline = scenarios.synthetic_year(template, 2004, freq="1 day")
    more = [{"name": "more", "start_mw": 200_000.0, "yoy_growth": 0.1}]
    return rounded(scenario_run.strain_under_scenarios(baseline, daily_threshold(filled), more, years=(2004, 2004)), 4)


@query(
    "u2_baseline_and_scenario_rows",
    sql.ctes(sql.DAILY_FORECAST, _long("forecast", _DAILY_LIST, "flat"))
    + "SELECT scenario, count(*) AS row_count, round(sum(y_hat), 2) AS y_hat FROM long GROUP BY 1",
)
def baseline_and_scenario_rows(spark, sf):
    forecast = daily_forecast(spark, sf).select("timestamp", "y_hat")
    rows = scenarios.apply_scenarios(forecast, DAILY_SCENARIOS, years=(1995, 2001))
    counted = rows.groupBy("scenario").agg(F.count("*").alias("row_count"), F.sum("y_hat").alias("y_hat"))
    return rounded(counted, 2)

"""The data behind figures and paragraphs."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.forecasting import _BACKTEST, _ERRORS, two_models
from tidewatt.catalog.inputs import daily_forecast, hourly_forecast, written_daily, written_hourly
from tidewatt.catalog.registry import query, rounded
from tidewatt.catalog.scenario_queries import _DAILY_STRAIN, _NAMES, _STRAIN, daily_strain
from tidewatt.plans import backtest, reports

_STRAIN_CTE = f", strain AS ({_STRAIN.format(keys='', d=4, source='long, t')})\n"


@query(
    "r1_rmse_comparison",
    _BACKTEST.rstrip()
    + ", "
    + _ERRORS
    + "SELECT model, round(rmse, 2) AS rmse FROM errors WHERE split = 'test' ORDER BY rmse, model",
)
def rmse_comparison(spark, sf):
    dataset, models = two_models(spark, sf)
    table = backtest.metrics_table(backtest.predictions(dataset, models), [m.name for m in models])
    return rounded(reports.rmse_comparison(table), 2)


@query(
    "r2_peak_window",
    sql.ctes(sql.HOURLY_FORECAST)
    + """, days AS (SELECT event_type, timestamp::DATE AS day, max(y) AS m FROM hourly_forecast GROUP BY 1, 2),
      peaks AS (SELECT event_type, day AS peak_day FROM (SELECT *, row_number() OVER (PARTITION BY event_type
                ORDER BY m DESC, day) AS r FROM days) WHERE r = 1)
      SELECT event_type, timestamp, round(y, 6) AS y, round(y_hat, 6) AS y_hat, peak_day
      FROM hourly_forecast JOIN peaks USING (event_type)
      WHERE timestamp BETWEEN peak_day - INTERVAL 7 DAY AND peak_day + INTERVAL 7 DAY""",
)
def peak_window(spark, sf):
    return rounded(reports.peak_window(hourly_forecast(spark, sf, written_hourly(spark, sf)), ["event_type"]))


@query(
    "r2_w4_peak_day",
    sql.ctes(sql.HOURLY_FORECAST)
    + """, days AS (SELECT event_type, timestamp::DATE AS day, max(y) AS m FROM hourly_forecast GROUP BY 1, 2)
      SELECT event_type, day AS peak_day, round(m, 6) AS peak FROM (SELECT *, row_number() OVER (
        PARTITION BY event_type ORDER BY m DESC, day) AS r FROM days) WHERE r = 1""",
)
def peak_day(spark, sf):
    return rounded(reports.peak_day(hourly_forecast(spark, sf), ["event_type"]))


@query(
    "r2_peak_window_one_series",
    sql.ctes(sql.DAILY_FORECAST)
    + """, p AS (SELECT timestamp AS peak FROM forecast ORDER BY y DESC, timestamp LIMIT 1)
      SELECT timestamp, round(y, 4) AS y, round(y_hat, 4) AS y_hat, peak::DATE AS peak_day FROM forecast, p
      WHERE timestamp BETWEEN peak - INTERVAL 7 DAY AND peak + INTERVAL 7 DAY""",
)
def peak_window_one_series(spark, sf):
    return rounded(reports.peak_window(daily_forecast(spark, sf, written_daily(spark, sf))), 4)


@query(
    "r3_monthly_peak_bounds",
    sql.ctes(sql.DAILY_FORECAST)
    + """SELECT round(least(min(a), min(p)), 4) AS low, round(greatest(max(a), max(p)), 4) AS high FROM (
         SELECT max(y) AS a, max(y_hat) AS p FROM forecast GROUP BY date_trunc('month', timestamp))""",
)
def monthly_peak_bounds(spark, sf):
    return rounded(reports.monthly_peak_bounds(daily_forecast(spark, sf)), 4)


def _pivot(value: str, names: list[str]) -> str:
    cases = ", ".join(f"max(CASE WHEN scenario = '{n}' THEN {value} END) AS {n}" for n in names)
    return f"SELECT year || 'Q' || quarter AS quarter_label, {cases} FROM strain GROUP BY 1"


@query("r4_p18_quarterly_peaks", _DAILY_STRAIN + _STRAIN_CTE + _pivot("predicted_peak_mw", _NAMES))
def quarterly_peaks(spark, sf):
    return rounded(reports.quarterly_peaks(daily_strain(spark, sf), _NAMES), 4)


@query("r5_high_hours_changes", _DAILY_STRAIN + _STRAIN_CTE + _pivot("high_hours_delta", _NAMES[1:]))
def high_hours_changes(spark, sf):
    return reports.high_hours_changes(daily_strain(spark, sf), _NAMES)


def _best_model(fact: str, split: str) -> str:
    return f"""(SELECT '{fact}' AS fact, model AS subject, NULL::VARCHAR AS quarter_label, round(rmse, 2) AS value
      FROM errors WHERE split = '{split}' ORDER BY value, subject LIMIT 1)"""


@query(
    "r6_report_facts",
    f"""SELECT * FROM ({_BACKTEST.rstrip()}, {_ERRORS}
        SELECT * FROM ({_best_model("best_test_rmse", "test")} UNION ALL {_best_model("best_val_rmse", "val")}))
      UNION ALL SELECT * FROM ({_DAILY_STRAIN.rstrip()}{_STRAIN_CTE} SELECT * FROM (
        (SELECT 'max_peak_uplift' AS fact, scenario AS subject, year || 'Q' || quarter AS quarter_label,
                peak_delta_mw AS value FROM strain ORDER BY peak_delta_mw DESC, year, quarter, scenario LIMIT 1)
        UNION ALL (SELECT 'max_high_hours_increase', scenario, year || 'Q' || quarter, high_hours_delta::DOUBLE
          FROM strain ORDER BY high_hours_delta DESC, year, quarter, scenario LIMIT 1)))""",
)
def report_facts(spark, sf):
    """From the back-test of two models and the strain of the daily forecast."""
    dataset, models = two_models(spark, sf)
    table = backtest.metrics_table(backtest.predictions(dataset, models), [m.name for m in models])
    return reports.report_facts(rounded(table, 2), rounded(daily_strain(spark, sf), 4))

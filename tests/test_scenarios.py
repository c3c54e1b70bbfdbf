import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatt.operators import contracts, scenarios
from tidewatt.plans import reports, scenario_run
from tidewatt.plans.backtest import ranking

RISING = [{"name": "a", "start_year": 2026, "end_year": 2027, "start_mw": 200.0, "yoy_growth": 0.05}]


def at(spark, *times):
    rows = ", ".join(f"(timestamp_ntz'{t}', 1000D)" for t in times)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(timestamp, y_hat)")


def adders(spark, shape, *times, listed=RISING):
    out = scenarios.apply_scenarios(at(spark, *times), listed, shape, years=(2026, 2026))
    return [r.ai_adder_mw for r in out.where("scenario = 'a'").orderBy("timestamp").collect()]


def test_yearly_levels(spark):
    base = spark.createDataFrame([("base", 2026, 2027, 350.0, 0.07)], scenarios.SCHEMA)
    assert [(r.year, round(r.mw, 6)) for r in scenarios.yearly_levels(base).orderBy("year").collect()] == [
        (2026, 350.0),
        (2027, 374.5),
    ]


def test_linear_ramp(spark):
    got = adders(spark, "linear_within_year", "2026-01-01 00:00:00", "2026-03-01 07:00:00", "2026-12-31 23:00:00")
    hour = (31 + 28) * 24 + 7
    assert got == pytest.approx([200, 200 + 10 * hour / 8759, 210])


def test_quarterly_ramp(spark):
    got = adders(spark, "step_quarterly", "2026-03-31 23:00:00", "2026-04-01 00:00:00", "2026-09-30 23:00:00", "2026-12-31 23:00:00")
    assert got == pytest.approx([200, 200 + 10 / 3, 200 + 20 / 3, 210])


@pytest.mark.parametrize("shape", scenarios.RAMPS)
def test_last_year_stays_level(spark, shape):
    listed = [{**RISING[0], "end_year": 2026}]
    assert adders(spark, shape, "2026-01-01 00:00:00", "2026-12-31 23:00:00", listed=listed) == [200, 200]


@pytest.mark.parametrize("shape", scenarios.RAMPS)
def test_list_and_table_agree(spark, shape):
    df = spark.sql(
        "SELECT timestampadd(HOUR, id * 7, timestamp_ntz'2026-01-01') AS timestamp, id * 1D AS y_hat FROM range(2400)"
    )
    table = spark.createDataFrame([("a", 2026, 2027, 200.0, 0.05), ("b", None, None, 10.0, 0.5)], scenarios.SCHEMA)
    listed = [*RISING, {"name": "b", "start_mw": 10.0, "yoy_growth": 0.5}]
    one = scenarios.apply_scenarios(df, listed, shape)
    two = scenarios.apply_scenarios(df, table, shape)
    three = scenarios.with_adder(df, scenarios.yearly_levels(table.where("name = 'a'"), ()), shape)
    assert one.count() == 3 * 2400

    def total(rows):
        sums = rows.groupBy("scenario").agg(F.sum("ai_adder_mw"), F.max("ai_adder_mw")).orderBy("scenario").collect()
        return [(r[0], round(r[1], 5), round(r[2], 8)) for r in sums]

    assert total(one) == total(two)
    assert total(three.withColumn("scenario", F.lit("a"))) == total(one.where("scenario = 'a'"))


def test_rejected_scenarios(spark):
    df = at(spark, "2026-01-01 00:00:00", "2028-01-01 00:00:00")
    for bad, told in (
        ([{"name": "a", "start_mw": 1.0}], "yoy_growth"),
        ([{**RISING[0], "start_year": 2030, "end_year": 2031}], "overlap"),
        (RISING, "2028"),
        ([{**RISING[0], "end_year": 2028, "start_mw": 0.0}], "nothing"),
    ):
        with pytest.raises(scenarios.ScenarioError, match=told):
            scenarios.apply_scenarios(df, bad)
    with pytest.raises(scenarios.ScenarioError, match="unknown ramp"):
        scenarios.apply_scenarios(df.limit(1), RISING, "steep", years=(2026, 2026))
    table = spark.createDataFrame([("a", 2026, 2027, 200.0, 0.05)], scenarios.SCHEMA)
    with pytest.raises(Exception, match="no level of a for 2028"):
        scenarios.apply_scenarios(df, table).collect()
    levels = scenarios.yearly_levels(table, ())
    with pytest.raises(Exception, match="no scenario level"):
        scenarios.with_adder(df, levels).collect()
    assert {r.ai_adder_mw for r in scenarios.with_adder(df, levels, allow_missing_years=True).collect()} == {200, 0}


def test_strain_and_its_reports(spark):
    df = spark.sql(
        "SELECT timestampadd(HOUR, id, timestamp_ntz'2026-01-01') AS timestamp, 1000D + id % 100 AS y_hat FROM range(8760)"
    )
    limit = spark.createDataFrame([(1090.0,)], "threshold double")
    listed = [{"name": n, "start_mw": mw, "yoy_growth": 0.0} for n, mw in (("low", 5.0), ("high", 50.0))]
    strain = scenario_run.strain_under_scenarios(df, limit, listed)
    rows = {(r.quarter, r.scenario): r for r in strain.collect()}
    assert len(rows) == 12
    assert rows[1, "baseline"].predicted_peak_mw == 1099
    assert rows[1, "high"].peak_delta_mw == 50
    # values equal to the threshold do not count
    above = sum(1 for i in range(2160) if 1000 + i % 100 > 1090)
    assert rows[1, "baseline"].predicted_high_hours == above
    for q in (1, 2, 3, 4):
        hours = [rows[q, s].predicted_high_hours for s in ("baseline", "low", "high")]
        assert hours == sorted(hours)
    names = ["baseline", "low", "high"]
    wide = reports.quarterly_peaks(strain, names).where("quarter_label = '2026Q2'").first()
    assert (wide.baseline, wide.low, wide.high) == (1099, 1104, 1149)
    assert reports.high_hours_changes(strain, names).columns == ["quarter_label", "low", "high"]
    season = scenarios.season_summary(strain).where("quarter = 3").collect()
    assert {r.scenario: r.peak_change for r in season} == {"baseline": "", "low": "+5", "high": "+50"}
    table = spark.createDataFrame([("x", 2.0, None), ("y", 1.0, 5.0), ("z", None, 4.0)], "model string, test_rmse double, val_rmse double")
    facts = {r.fact: r for r in reports.report_facts(table, strain).collect()}
    assert facts["best_test_rmse"].subject == "y" and facts["best_val_rmse"].subject == "z"
    assert (facts["max_peak_uplift"].subject, facts["max_peak_uplift"].quarter_label) == ("high", "2026Q1")
    assert [r.model for r in reports.rmse_comparison(table).collect()] == ["y", "x"]
    assert [r.model for r in ranking(table).collect()] == ["y", "x"]


def test_synthetic_year(spark):
    template = spark.sql(
        """SELECT timestampadd(HOUR, id, timestamp_ntz'2025-01-01') AS timestamp,
           CASE WHEN id = 30 THEN NULL ELSE id * 1D END AS y_hat FROM range(8760) WHERE id <> 40"""
    )
    leap = {r.timestamp: r.y_hat for r in scenarios.synthetic_year(template, 2028).collect()}
    known = {r.timestamp: r.y_hat for r in template.collect()}
    assert len(leap) == 8784
    assert leap[dt.datetime(2028, 2, 29, 5)] == known[dt.datetime(2025, 2, 28, 5)]
    assert leap[dt.datetime(2028, 1, 2, 6)] is None  # known to be unknown
    same_hour = [v for t, v in known.items() if t.hour == 16]
    assert leap[dt.datetime(2028, 1, 2, 16)] == pytest.approx(sum(same_hour) / len(same_hour))
    common = scenarios.synthetic_year(template.where("hour(timestamp) <> 3"), 2026)
    assert common.count() == 8760
    assert common.where("hour(timestamp) = 3").agg(F.max("y_hat"), F.min("y_hat")).first()[:] == (0, 0)


def test_peak_window_is_fourteen_days_and_an_hour(series):
    y = [1.0] * 2000
    y[1000] = y[1001] = 5.0
    df = series(y=y).withColumn("y_hat", F.col("y"))
    assert reports.peak_window(df).count() == 337
    assert reports.peak_window(df.limit(23)).count() == 0


def test_contract_report(series):
    df = series(hours=[0, 1, 1, 3], y=[1, None, 2, 3])
    found = {r.rule: r for r in contracts.series_rules(df, ["timestamp"], "y", partial_year=2024).collect()}
    assert {k: v.violations for k, v in found.items()} == {
        "unique_timestamp": 1,
        "continuous": 2,
        "target_not_null": 1,
        "full_year": 1,
    }
    assert "2024-01-01" in found["unique_timestamp"].examples[0]
    with pytest.raises(contracts.ContractError, match="unique_timestamp: 1"):
        contracts.enforce(contracts.series_rules(df, ["timestamp"], "y"))
    with pytest.raises(contracts.ContractError, match="source_file"):
        contracts.require_columns(df, contracts.DEMAND_COLUMNS)
    fine = series(y=[1, 2, 3])
    contracts.enforce(contracts.series_rules(fine, ["timestamp"], "y", partial_year=2024))
    assert contracts.bad_hours(fine.selectExpr("explode(array(0, 1, 24, 25, null)) AS Hour")).distinct().count() == 3


@pytest.mark.parametrize("shape", scenarios.RAMPS)
def test_a_year_without_level_is_an_error_whatever_years_says(spark, shape):
    out = scenarios.apply_scenarios(at(spark, "2026-01-01 00:00:00", "2030-01-01 00:00:00"), RISING, shape, years=(2026, 2027))
    with pytest.raises(Exception, match="no level of scenario a for year 2030"):
        out.collect()
    early = scenarios.apply_scenarios(at(spark, "2025-01-01 00:00:00"), RISING, shape, years=(2026, 2027))
    with pytest.raises(Exception, match="2025"):
        early.collect()


def test_repeated_template_times_give_one_row(spark):
    rows = at(spark, "2024-01-01 00:00:00", "2024-01-01 00:00:00").withColumn("y_hat", F.col("y_hat") + F.monotonically_increasing_id())
    out = scenarios.synthetic_year(rows, 2026)
    assert out.count() == 8760
    assert out.orderBy("timestamp").first().y_hat == 1000

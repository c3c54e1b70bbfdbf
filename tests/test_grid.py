import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.functions.timeline import floor_to, to_micros
from tidewatt.operators import buckets, contracts, grid, lookback, windows
from tidewatt.operators.joins import WEATHER_MEASURES
from tidewatt.plans import features

HOLES = [None, 1, None, None, 4, None]


def values(df, column="y"):
    return [r[column] for r in df.orderBy("timestamp").collect()]


def test_fills_on_the_micro_fixture(series):
    df = series(y=HOLES)
    assert values(grid.fill(df, ["y"])) == [1, 1, 2, 3, 4, 4]
    assert values(grid.interpolate(df, ["y"])) == [None, 1, 2, 3, 4, 4]
    assert values(grid.forward_fill(df, ["y"])) == [None, 1, 1, 1, 4, 4]
    assert values(grid.backward_fill(df, ["y"])) == [1, 1, 4, 4, 4, None]


@pytest.mark.parametrize("steps", [1, 2, 3, 7, None])
def test_fills_do_not_depend_on_the_bucket(series, steps):
    rng = np.random.default_rng(7)
    y = [None if rng.random() < 0.7 else float(v) for v in rng.integers(0, 100, 60)]
    hours = sorted(rng.choice(200, 60, replace=False))
    df = series(y=y, hours=hours)
    at = pd.to_datetime("2024-01-01") + pd.to_timedelta(hours, unit="h")
    expected = pd.Series(y, index=at, dtype=float)
    for name, got in {
        "interpolate": grid.interpolate(df, ["y"], steps=steps),
        "ffill": grid.forward_fill(df, ["y"], steps=steps),
        "bfill": grid.backward_fill(df, ["y"], steps=steps),
    }.items():
        want = expected.interpolate(method="time") if name == "interpolate" else getattr(expected, name)()
        have = np.array([np.nan if v is None else v for v in values(got)])
        np.testing.assert_allclose(have, want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("steps", [2, 5, 4096, None])
def test_regularise_is_a_gap_free_grid(series, steps):
    df = series(hours=[0, 1, 5, 6, 30], y=[1, None, 3, 4, 28], z=[None, 2, 2, None, None])
    out = grid.regularise(df.withColumn("source_file", F.lit("a")), ["y", "z"], source="source_file", steps=steps)
    rows = out.orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(31)]
    np.testing.assert_allclose([r.y for r in rows][:6], [1, 1.4, 1.8, 2.2, 2.6, 3])
    assert [r.y for r in rows][6:8] == [4, 5] and rows[30].y == 28
    assert all(r.z == 2 for r in rows)
    assert {i for i, r in enumerate(rows) if r.source_file == "a"} == {0, 1, 5, 6, 30}
    assert {i for i, r in enumerate(rows) if not r.is_imputed} == {5}
    assert contracts.gaps(out).count() == 0


def test_long_gap_and_several_series(spark):
    df = spark.sql(
        """SELECT * FROM VALUES ('a', timestamp_ntz'2020-01-01', 0D), ('a', timestamp_ntz'2022-01-01', 17544D),
           ('b', timestamp_ntz'2021-05-05 05:00:00', 9D), (NULL, timestamp_ntz'2021-05-05 05:00:00', 1D),
           (NULL, timestamp_ntz'2021-05-05 07:00:00', 3D) AS t(k, timestamp, y)"""
    )
    out = grid.regularise(df, ["y"], keys=["k"])
    assert {r.k: r["count"] for r in out.groupBy("k").count().collect()} == {"a": 17545, "b": 1, None: 3}
    hours = (to_micros("timestamp") - to_micros(F.lit("2020-01-01").cast("timestamp_ntz"))) / 3_600_000_000
    off = out.where("k = 'a'").agg(F.max(F.abs(F.col("y") - hours))).first()[0]
    assert off < 1e-8


def test_rows_between_steps_are_left_out_and_reported(series):
    df = series(y=[1, 2, 3], step_seconds=1800, hours=[0, 1, 4])
    out = grid.regularise(df, ["y"])
    assert values(out) == [1, 2, 3]
    assert contracts.off_grid(df).count() == 1


def test_times_skipped_by_daylight_saving_stay_apart(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Toronto")
    try:
        df = spark.sql(
            "SELECT timestampadd(HOUR, id, timestamp_ntz'2024-03-09 20:00:00') AS timestamp, 1D AS y FROM range(12)"
        )
        assert df.select(floor_to("timestamp", "1 hour").alias("t")).distinct().count() == 12
        assert contracts.gaps(df).count() == 0
        assert grid.regularise(df.where("hour(timestamp) <> 2"), ["y"]).count() == 12
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# --- windows --------------------------------------------------------------------


def test_rolling_mean_micro_fixture(series):
    out = windows.with_lags_and_means(series(y=[0, 1, 2]), lags={"l": 1}, means={"m": 24})
    assert values(out, "m") == [None, 0, 0.5]
    assert values(out, "l") == [None, 0, 1]


@pytest.mark.parametrize("steps", [64, None])
def test_lags_and_means_equal_pandas(series, steps):
    rng = np.random.default_rng(3)
    y = rng.normal(2e4, 3e3, 700)
    y[rng.random(700) < 0.1] = np.nan
    y[100:140] = np.nan
    df = series(y=[None if np.isnan(v) else v for v in y])
    out = windows.with_lags_and_means(df, lags={"l": 7}, means={"m3": 3, "m20": 20}, steps=steps)
    s = pd.Series(y)
    want = {"l": s.shift(7)}
    want |= {f"m{n}": s.shift(1).rolling(n, min_periods=1).mean() for n in (3, 20)}
    got = out.orderBy("timestamp").toPandas()
    for c, expected in want.items():
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), expected.to_numpy(), rtol=1e-12)


def test_rolling_mean_survives_mixed_magnitudes(series):
    y = [1e15, 3.0, 1e-3, 2.0, 2.5] * 30
    got = values(windows.with_lags_and_means(series(y=y), lags={}, means={"m": 2}), "m")
    want = pd.Series(y).shift(1).rolling(2, min_periods=1).apply(np.nanmean).tolist()
    np.testing.assert_allclose(got[1:], want[1:], rtol=1e-3)


def test_gaps_and_overlaps(series):
    found = contracts.gaps(series(hours=[0, 1, 3], y=[1, 1, 1])).collect()
    assert [(r.kind, r.gap_seconds) for r in found] == [("gap", 7200.0)]
    found = contracts.gaps(series(hours=[0, 0, 1], y=[1, 1, 1])).collect()
    assert [(r.kind, r.gap_seconds) for r in found] == [("overlap", 0.0)]
    assert contracts.gaps(series(hours=[0], y=[1])).count() == 0
    assert contracts.gaps(series(hours=[3, 1, 2], y=[1, 1, 1])).count() == 0


def test_first_maximum_takes_the_first_of_equals(series):
    df = series(y=[1, 5, None, 5]).withColumn("h", F.hour("timestamp"))
    row = windows.first_maximum(df, "y", [F.col("timestamp")], ["h"]).first()
    assert (row.h, row.y) == (1, 5)


@pytest.mark.parametrize("steps", [24, 4096, None])
@pytest.mark.parametrize("hours", [[0, 1, 2, 4, 5], [0, 1, 1, 2, 3]])
def test_lags_need_a_complete_grid(series, steps, hours):
    df = series(hours=hours, y=[1, 2, 3, 4, 5])
    with pytest.raises(Exception, match="not a complete grid"):
        windows.with_lags_and_means(df, "y", {"a": 1}, {"m": 2}, steps=steps).select("a").collect()


def test_a_duplicate_time_has_no_place_on_the_grid(series):
    with pytest.raises(Exception, match="duplicate time"):
        grid.regularise(series(hours=[0, 1, 1, 2], y=[1, 2, 3, 4]), ["y"]).collect()


@pytest.mark.parametrize("steps", [8, 64, None])
@pytest.mark.parametrize("gap", [1, 2, 9, 61])
@pytest.mark.parametrize("start", [63, 64, 70])
def test_holes_of_any_length_at_any_place_are_found(series, steps, gap, start):
    hours = [h for h in range(200) if not start <= h < start + gap]
    df = series(hours=hours, y=hours)
    with pytest.raises(Exception, match="not a complete grid"):
        windows.with_lags_and_means(df, "y", {"a": 1}, {"m": 2}, steps=steps).select("a").collect()


def test_a_hole_over_the_edge_of_a_default_bucket_is_found(series):
    hours = [*range(3000, 3800), *range(4300, 4600)]
    with pytest.raises(Exception, match="not a complete grid"):
        windows.with_lags_and_means(series(start="1970-01-01 00:00:00", hours=hours, y=hours)).select("demand_lag_1h").collect()


@pytest.mark.parametrize("steps", [16, 40, 64, None])
@pytest.mark.parametrize("known", [0.0, 0.02, 0.3])
def test_filled_values_and_lags_of_one_frame_equal_two(series, steps, known):
    """The lags of filled values, halo copies included, are those of the values filled before."""
    rng = np.random.default_rng(int(known * 100))
    y = [float(v) if rng.random() < known else None for v in rng.integers(0, 1000, 300)]
    z = [float(v) if rng.random() < 0.5 else None for v in rng.integers(0, 1000, 300)]
    df = series(y=y, z=z)
    got = lookback.fill_and_look_back(df, ["y", "z"], "y", {"l1": 1, "l2": 2}, {"m": 2}, steps=steps)
    want = grid.fill(df, ["y", "z"], steps=None)
    want = windows.with_lags_and_means(want, "y", {"l1": 1, "l2": 2}, {"m": 2}, steps=None)
    have, expected = (f.orderBy("timestamp").toPandas()[["y", "z", "l1", "l2", "m"]].to_numpy(dtype=float) for f in (got, want))
    np.testing.assert_allclose(have, expected, rtol=1e-12)


def test_one_frame_for_several_series_of_any_start(spark):
    df = spark.range(900).selectExpr(
        "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS k",
        "timestampadd(HOUR, id div 3 + (id % 3) * 1000, timestamp_ntz'2023-12-20 00:00:00') AS timestamp",
        "CASE WHEN hash(id) % 4 = 0 THEN id / 1D END AS x",
        "id / 3D AS y",
    )
    how = dict(fills=["x"], value="y", lags={"l": 5}, means={"m": 4}, keys=["k"])
    rows = [lookback.fill_and_look_back(df, steps=steps, **how).orderBy("k", "timestamp").toPandas() for steps in (40, 96, None)]
    for other in rows[:2]:
        pd.testing.assert_frame_equal(other, rows[2])


def test_the_model_dataset_shuffles_full_rows_once(spark, tmp_path):
    paths = {}
    for name, expr in {"demand": ["id / 2D AS ontario_demand_mw", "1D AS market_demand_mw", "false AS is_imputed"], "weather": ["id / 3D AS temp_c", "CAST(NULL AS double) AS precip_mm"]}.items():
        paths[name] = f"{tmp_path}/{name}"
        spark.range(400).selectExpr("timestampadd(HOUR, id, timestamp_ntz'2024-01-01') AS timestamp", *expr).write.parquet(paths[name])
    demand, weather = (spark.read.parquet(paths[n]) for n in ("demand", "weather"))
    out = features.model_dataset(demand, weather, features.FeatureSettings(lags={"l": 2}, means={"m": 3}))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # the joined rows move once, to their buckets; beside them a row for each task and bucket of the summary,
    # twice (the blocks and their window), and rows for each block
    assert sum("__bucket" in e for e in exchanges) == 1
    assert "Exchange SinglePartition" not in plan
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*temp_c", final)) == 2 and "ReusedExchange" in final


def test_the_model_dataset_does_not_depend_on_the_bucket(spark):
    hours = spark.range(900).selectExpr("timestampadd(HOUR, id, timestamp_ntz'2024-01-01') AS timestamp", "id")
    demand = hours.selectExpr("timestamp", "abs(hash(id)) % 1000 / 2D AS ontario_demand_mw", "1D AS market_demand_mw", "false AS is_imputed")
    measures = [f"CASE WHEN abs(hash(id, '{c}')) % 3 = 0 THEN abs(hash(id)) % 77 / 4D END AS {c}" for c in WEATHER_MEASURES]
    weather = hours.where("id % 5 > 0").selectExpr("timestamp", *measures, "id % 7 = 0 AS is_imputed_weather")
    made = [features.model_dataset(demand, weather, features.FeatureSettings(steps=s)).orderBy("timestamp").toPandas() for s in (None, 1, 2000)]
    assert len(made[0]) == 900
    for other in made[1:]:
        pd.testing.assert_frame_equal(made[0], other)


# --- the report of rules ----------------------------------------------------------


def _plain_report(rows, step=3600, year=2024, full=8760):
    """Rules one by one in plain Python: {rule: (violations, examples)}."""
    import collections
    import json

    def shown(**columns):
        return json.dumps(columns, separators=(",", ":"))

    def at(t):
        return None if t is None else t.strftime("%Y-%m-%dT%H:%M:%S.000")

    found = {"unique_timestamp": [], "continuous": [], "target_not_null": [], "full_year": []}
    for (k, t), n in collections.Counter((k, t) for k, t, _ in rows).items():
        if n > 1:
            found["unique_timestamp"].append(shown(k=k, timestamp=at(t), row_count=n).replace('"timestamp":null,', '"timestamp":null,'))
    for k in {k for k, _, _ in rows}:
        times = sorted(t for key, t, _ in rows if key == k and t is not None)
        for a, b in zip(times, times[1:]):
            gap = (b - a).total_seconds()
            if abs(gap - step) > 1:
                found["continuous"].append(shown(k=k, timestamp=at(b), gap_seconds=gap, kind="gap" if gap > step else "overlap"))
        n = sum(t.year == year for t in times)
        if 0 < n < full:
            found["full_year"].append(shown(k=k, year=year, row_count=n))
    found["target_not_null"] = [shown(k=k, timestamp=at(t)) for k, t, y in rows if y is None]
    return {rule: (len(v), sorted(v)[:5]) for rule, v in found.items()}


def test_report_equals_plain_rules(spark):
    rng = np.random.default_rng(12)
    start = dt.datetime(2023, 1, 1)
    rows = []
    for k, count in (("a", 9000), ("b", 300), (None, 200)):
        hours = np.sort(rng.choice(12_000, count, replace=False))
        rows += [(k, start + dt.timedelta(hours=int(h)), None if rng.random() < 0.01 else 1.5) for h in hours]
    rows += [rows[5], rows[5], rows[8000], rows[9100], ("b", None, 2.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, y double").repartition(7)
    made = contracts.series_rules(df, ["timestamp", "y"], "y", keys=["k"], partial_year=2024).collect()
    assert {r.rule: (r.violations, r.examples) for r in made} == _plain_report(rows)
    assert {r.rule: r.severity for r in made}["full_year"] == "warning"


def test_report_reads_the_table_for_the_rules_and_for_the_buckets(spark, series, tmp_path):
    path = f"{tmp_path}/rows"
    series(y=[1, None, 3], hours=[0, 1, 5]).write.parquet(path)
    out = contracts.series_rules(spark.read.parquet(path), ["timestamp"], "y", partial_year=2024)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") == 2
    assert [(r.rule, r.violations) for r in out.orderBy("rule").collect()] == [("continuous", 1), ("full_year", 1), ("target_not_null", 1), ("unique_timestamp", 0)]
    assert out.where("rule = 'full_year'").first().examples == ['{"year":2024,"row_count":3}']


def test_report_of_an_empty_table_passes(spark):
    empty = spark.createDataFrame([], "k string, timestamp timestamp_ntz, y double")
    made = contracts.series_rules(empty, ["timestamp"], "y", keys=["k"], partial_year=2024).collect()
    assert len(made) == 4 and all(r.violations == 0 and r.examples == [] for r in made)


@pytest.mark.parametrize("slots", [2, 3, 7])
@pytest.mark.parametrize("heads", [False, True])
def test_a_summary_scanned_in_levels_equals_one_window(spark, monkeypatch, slots, heads):
    """Buckets of width 10 with holes, unknown values, several series and times before 1970."""
    rng = np.random.default_rng(slots)
    rows = []
    for key in (None, "a", "b"):
        for bucket in sorted(rng.choice(np.arange(-60, 60), 45, replace=False).tolist()):
            known = rng.random() < 0.4
            head = known and rng.random() < 0.5
            at = bucket * 10
            first, last = (at + 1, 1.0 * bucket), (at + 9, bucket + 0.5)
            rows.append((key, at, *(first if known else (None, None)), *((at + 4, bucket + 0.25) if head else (None, None)), *(last if known else (None, None))))
    names = [f"__{n}_{p}_y" for n in ("first", "head", "last") for p in ("t", "v")]
    summary = spark.createDataFrame(rows, "k string, __bucket bigint, " + ", ".join(f"{n} {'bigint' if '_t_' in n else 'double'}" for n in names))
    if heads:  # a known last that is not the head is in the tail
        tail = F.col("__last_t_y") > F.coalesce("__head_t_y", F.lit(-1000))
        summary = summary.withColumns({f"__tail_{p}_y": F.when(tail, F.col(f"__last_{p}_y")) for p in "tv"}).drop("__last_t_y", "__last_v_y")
    else:
        summary = summary.drop("__head_t_y", "__head_v_y")
    monkeypatch.setattr(buckets, "_YEARS", 1000)
    levels = {tuple(r) for r in buckets.known_beyond(summary, ["y"], ["k"], 10, slots).collect()}
    expected = set()
    for key, at, *_ in rows:
        before, after = (None, None), (None, None)
        for other, place, ft, fv, ht, hv, lt, lv in rows:
            if other == key and place < at and (lt if place < at - 10 or not heads else ht) is not None:
                found = (lt, lv) if place < at - 10 or not heads else (ht, hv)
                before = found if before[0] is None or found[0] > before[0] else before
            if other == key and place > at and ft is not None:
                after = (ft, fv) if after[0] is None or ft < after[0] else after
        expected.add((key, at, before[0], after[0], before[1], after[1]))
    assert levels == expected


def test_no_keys_no_single_task(spark, series):
    """Fills of one unkeyed series: no exchange into a single partition, and the summary is read once."""
    raw = series(y=[1.0, None, 3.0, None, None, 6.0], hours=[0, 1, 2, 5, 9000, 20000])
    plan = grid.regularise(raw, ["y"], flag_columns=["y"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from tidewatt.functions import calendar, cleaning
from tidewatt.operators import scenarios
from tidewatt.operators.contracts import ContractError
from tidewatt.sources import demand, headers, tables, weather


def demand_file(folder, year, rows, header="Date,Hour,Market Demand,Ontario Demand", comments=True):
    text = "\\Hourly demand\n\\for one year\n\n" if comments else ""
    (folder / f"PUB_Demand_{year}.csv").write_text(text + header + "\n" + "\n".join(rows) + "\n")


def test_demand_scan_by_name_not_position(spark, tmp_path):
    demand_file(tmp_path, 2023, ["2023-12-31,24,200,100", "2023-12-31,23,x,99"])
    demand_file(tmp_path, 2024, ["101,2024-01-01,1,201"], "Ontario Demand,Date,Hour,Market Demand", comments=False)
    rows = demand.read_demand(spark, str(tmp_path), [2023, 2024]).orderBy("timestamp").collect()
    assert [tuple(r) for r in rows] == [
        (dt.datetime(2023, 12, 31, 22), 99.0, None, "PUB_Demand_2023.csv"),
        (dt.datetime(2023, 12, 31, 23), 100.0, 200.0, "PUB_Demand_2023.csv"),
        (dt.datetime(2024, 1, 1, 0), 101.0, 201.0, "PUB_Demand_2024.csv"),
    ]
    filled = demand.hourly_demand(demand.read_demand(spark, str(tmp_path))).orderBy("timestamp").collect()
    assert [r.is_imputed for r in filled] == [True, False, False]
    assert filled[0].market_demand_mw == 200.0


def test_demand_errors(spark, tmp_path):
    demand_file(tmp_path, 2024, ["2024-01-01,25,1,1"])
    with pytest.raises(FileNotFoundError, match=r"\[2022, 2023\]"):
        demand.read_demand(spark, str(tmp_path), [2022, 2023, 2024])
    with pytest.raises(Exception, match="bad Date or Hour"):
        demand.read_demand(spark, str(tmp_path)).collect()
    demand_file(tmp_path, 2024, ["2024-01-01,1,1"], "Date,Hour,Market Demand")
    assert [r.missing for r in demand.header_findings(spark, str(tmp_path)).collect()] == [["Ontario Demand"]]
    with pytest.raises(ValueError, match="Ontario Demand"):
        demand.read_demand(spark, str(tmp_path))


def test_demand_comments_anywhere(spark, tmp_path):
    """A header far down, comments after values, and a file without header."""
    lead = "".join(f"\\ line {i}\n" for i in range(40))
    text = lead + "Date,Hour,Market Demand,Ontario Demand\n2024-01-01,1,3\\note,2\n\\ all of it\n2024-01-01,2,5,4 \\ end\n"
    (tmp_path / "PUB_Demand_2024.csv").write_text(text)
    rows = demand.read_demand(spark, str(tmp_path), [2024]).orderBy("timestamp").collect()
    assert [(r.market_demand_mw, r.ontario_demand_mw) for r in rows] == [(3.0, None), (5.0, 4.0)]
    assert [r.missing for r in demand.header_findings(spark, str(tmp_path)).collect()] == [demand.REQUIRED]
    (tmp_path / "PUB_Demand_2025.csv").write_text("\\ only\n\\ comments\n")
    with pytest.raises(ValueError, match="no header in .*2025"):
        demand.read_demand(spark, str(tmp_path))


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    (tmp_path / "2022").mkdir()
    lines = [f"2022-01-{1 + i // 24 % 28:02d} {i % 24:02d}:00,{i % 30}" for i in range(9000)]
    text = "Date/Time (LST),Temp (°C)\n".replace("°", "deg ") + "\n".join(lines) + "\n2023-01-01 00:00,\u00a07.5\n"
    (tmp_path / "2022" / "a b+c%20.csv").write_bytes(text.replace("deg ", "deg").encode("latin-1"))
    found = headers.heads(spark, str(tmp_path)).first()
    assert found.encoding == "ISO-8859-1" and found.line == 1
    rows, _ = weather.read_weather(spark, str(tmp_path))
    assert rows.count() == 9001
    assert rows.where("year(timestamp) = 2023").first().temp_c == 7.5


def test_stages_fail_on_what_spoils_them(spark, tmp_path):
    demand_file(tmp_path, 2024, ["2024-01-01,1,1,1", "2024-01-01,1,2,2", "2024-01-01,3,2,2"])
    raw = demand.read_demand(spark, str(tmp_path))
    with pytest.raises(Exception, match="duplicate time"):
        demand.hourly_demand(raw).collect()
    none = raw.dropDuplicates(["timestamp"]).withColumn("ontario_demand_mw", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no value of ontario_demand_mw"):
        demand.hourly_demand(none).collect()
    cold = spark.sql("SELECT timestamp_ntz'2024-01-01' AS timestamp, 'a' AS source_file, CAST(NULL AS DOUBLE) AS temp_c, 1D AS rel_hum_pct")
    cold = cold.withColumns({m: F.lit(1.0) for m in weather.MEASURES if m not in cold.columns})
    with pytest.raises(Exception, match="no value of temp_c"):
        weather.hourly_weather(cold).collect()


def test_dates_need_a_day(spark):
    texts = ["2022", "2022-01", "2022-01-05", " 2022-01-05 07:00 ", "2022-01-05T07:30:00", "07:00", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(cleaning.readable_time(F.col("t")).alias("t"))
    day = dt.datetime(2022, 1, 5)
    assert [r.t for r in df.collect()] == [None, None, day, day.replace(hour=7), day.replace(hour=7, minute=30), None, None]


HEADER = "Date/Time (LST),Temp (°C),Temp Flag,Dew Point Temp (°C),Rel Hum (%),Wind Spd (km/h),Precip. Amount (mm),Stn Press (kPa)"


def test_weather_layouts_encodings_and_rejects(spark, tmp_path):
    for y in ("2022", "2023"):
        (tmp_path / y).mkdir()
    (tmp_path / "2022" / "01.csv").write_bytes(
        b"\xef\xbb\xbf" + (HEADER + '\n2022-01-01 00:00,"−4.5*",,1,50,"1,5",M,101.3\nbad,1,,1,1,1,1,1\n').encode()
    )
    (tmp_path / "2022" / "02.csv").write_bytes(
        ("Dew Point Temp (°C),Temp (°C),Date/Time (LST)\n2.5,7,2022-02-01 05:00\n").encode("latin-1")
    )
    (tmp_path / "2023" / "01.csv").write_text("Temp (°C),Rel Hum (%)\n1,2\n")
    (tmp_path / "2023" / "02.csv").write_text("\n\n")
    (tmp_path / "2023" / "03.csv").write_text(HEADER + "\n")
    rows, rejects = weather.read_weather(spark, str(tmp_path), 2022, 2023)
    got = {r.source_file: r for r in rows.collect()}
    assert set(got) == {"2022/01.csv", "2022/02.csv"}
    first, second = got["2022/01.csv"], got["2022/02.csv"]
    assert (first.temp_c, first.dewpoint_c, first.wind_spd_kmh, first.precip_mm) == (-4.5, 1.0, 1.5, None)
    assert (second.temp_c, second.dewpoint_c, second.rel_hum_pct) == (7.0, 2.5, None)
    assert second.timestamp == dt.datetime(2022, 2, 1, 5)
    assert sorted(r.path[-11:] for r in rejects.collect()) == ["2023/01.csv", "2023/02.csv"]
    with pytest.raises(FileNotFoundError):
        weather.read_weather(spark, str(tmp_path), 1990, 1991)


def test_hourly_weather_flags_temperature_only(spark, tmp_path):
    (tmp_path / "2022").mkdir()
    lines = [HEADER, "2022-01-01 00:00,1,,,5,,,", "2022-01-01 01:00,,,,6,,,", "2022-01-01 03:00,4,,,,,,"]
    (tmp_path / "2022" / "01.csv").write_text("\n".join(lines) + "\n")
    rows, _ = weather.read_weather(spark, str(tmp_path))
    out = weather.hourly_weather(rows).orderBy("timestamp").collect()
    assert [r.temp_c for r in out] == [1, 2, 3, 4]
    assert [r.rel_hum_pct for r in out] == [5, 6, 6, 6]
    assert [r.is_imputed_weather for r in out] == [False, True, True, False]
    assert [r.source_file for r in out] == ["2022/01.csv", "2022/01.csv", "IMPUTED", "2022/01.csv"]


def test_header_normal_form():
    assert headers.normal_header(" Temp (°C) ") == "temp degc"
    assert headers.normal_header("Temp (Â°C)") == "temp degc"
    assert headers.normal_header("Precip. Amount (mm)") == "precip amount mm"


def test_heads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\\a\n\\b\nDate,Hour\n")
    (tmp_path / "b.csv").write_bytes("a,°C\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"\n\\\n")
    (tmp_path / "d.csv").write_bytes(b"")
    found = {r.path[-5:]: (r.header, r.encoding) for r in headers.heads(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": ("Date,Hour", "UTF-8"), "b.csv": ("a,°C", "ISO-8859-1"), "c.csv": (None, "UTF-8")}


@pytest.mark.parametrize(
    "text, number",
    [(" 4.5* ", 4.5), ("−3", -3), ("1,5", 1.5), ("1,234.5", 1.234), ("M", None), ("", None), ("-.5", -0.5),
     ("5.", 5), ("NA", None), ('"7"', 7), ("1e-05", 1), ("1\u00a0234", 1234), (None, None)],
)
def test_dirty_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cleaning.dirty_number(F.col("t"))).first()[0] == number


def test_plain_numbers_and_nan(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("-.5e1",), ("5.",), ("x",), ("NaN",), ("",), ("1d",), ("0x1p3",)], "t string")
    got = [r[0] for r in df.select(cleaning.plain_number(F.col("t"))).collect()]
    assert got == [1.5, 2.0, -5.0, 5.0, None, None, None, None, None]
    df = spark.createDataFrame([(float("nan"), 1)], "a double, b int")
    assert cleaning.without_nan(df).first().a is None


def test_calendar_micro_fixtures(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS timestamp")
    row = calendar.with_calendar(df).first()
    assert (row.day_of_week, row.quarter, row.is_weekend, row.hour) == (0, 1, False, 0)
    temps = spark.createDataFrame([(10.0,), (25.0,), (None,)], "temp_c double")
    out = calendar.with_degree_days(temps).collect()
    assert [(r.hdd_18, r.cdd_18) for r in out] == [(8, 0), (0, 7), (None, None)]
    at = spark.sql(
        """SELECT explode(array(timestamp_ntz'2023-12-31 23:00:00', timestamp_ntz'2024-01-01 00:00:00',
           timestamp_ntz'2024-12-31 23:00:00', timestamp_ntz'2025-01-01 00:00:00')) AS t"""
    )
    assert [r[0] for r in at.select(calendar.split_label(F.col("t"))).collect()] == ["train", "val", "val", "test"]


def test_forecast_scan(spark, tmp_path, series):
    df = series(y_hat=[1, 2])
    tables.write_table(df, f"{tmp_path}/f.parquet")
    tables.write_report(df, f"{tmp_path}/f.csv")
    for suffix in ("parquet", "csv"):
        out = tables.read_forecast(spark, f"{tmp_path}/f.{suffix}")
        assert out.dtypes == [("timestamp", "timestamp_ntz"), ("y_hat", "double")]
        assert out.count() == 2
    with pytest.raises(ValueError, match="neither"):
        tables.read_forecast(spark, f"{tmp_path}/f.xlsx")
    tables.write_table(df.drop("y_hat"), f"{tmp_path}/g.parquet")
    with pytest.raises(ContractError, match="y_hat"):
        tables.read_forecast(spark, f"{tmp_path}/g.parquet")


def test_scenario_file(spark, tmp_path):
    tables.write_scenarios(scenarios.DEFAULT_SCENARIOS, f"{tmp_path}/s", spark)
    back = {r.name: r.asDict() for r in tables.read_scenarios(spark, f"{tmp_path}/s").collect()}
    assert back == {s["name"]: s for s in scenarios.DEFAULT_SCENARIOS}
    (tmp_path / "own.json").write_text(
        json.dumps({"scenarios": [{"name": "a", "start_mw": 5, "yoy_growth": 0}], "metadata": {}}, indent=1)
    )
    row = tables.read_scenarios(spark, f"{tmp_path}/own.json").first()
    assert (row.name, row.start_year, row.start_mw) == ("a", None, 5.0)
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(Exception):
        tables.read_scenarios(spark, f"{tmp_path}/none.json").collect()


def test_stages_are_removed(spark):
    import os

    from tidewatt.session import _written, remove_stages, staged

    staged(spark.range(3), "some").count()
    path = _written[-1].removeprefix("file://")
    assert os.path.isdir(path)
    kept = _written[:-1]
    del _written[:-1]  # other tests still read theirs
    remove_stages(spark)
    _written.extend(kept)
    assert not os.path.exists(path)


def test_any_number_of_headers_is_one_scan(spark, tmp_path):
    """Sixty layouts: the plan reads the files once, and every column is found in each of them."""
    names = ["Date", "Hour", "Market Demand", "Ontario Demand"]
    for i in range(60):
        order = [*names[i % 4 :], *[f"extra {k}" for k in range(i // 4)], *names[: i % 4]]
        cells = {"Date": "2024-01-01", "Hour": str(i % 24 + 1), "Market Demand": str(i), "Ontario Demand": f'"{i}.5"'}
        lines = [",".join(order), ",".join(cells.get(c, "x") for c in order)]
        (tmp_path / f"PUB_Demand_{1950 + i}.csv").write_text("\n".join(lines) + "\n")
    rows = demand.read_demand(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[value#", plan)) == 1
    got = {(r.timestamp.hour, r.market_demand_mw, r.ontario_demand_mw, r.source_file) for r in rows.collect()}
    assert got == {(i % 24, float(i), i + 0.5, f"PUB_Demand_{1950 + i}.csv") for i in range(60)}


def test_files_outside_the_years_are_not_read(spark, tmp_path):
    for year in (2020, 2021, 2022):
        (tmp_path / f"PUB_Demand_{year}.csv").write_text(f"Date,Hour,Market Demand,Ontario Demand\n{year}-01-01,1,1,2\n")
    (tmp_path / "PUB_Demand_2019.csv").write_text("nothing that could be read\n")
    rows = demand.read_demand(spark, str(tmp_path), [2020, 2022])
    assert sorted(r.timestamp.year for r in rows.collect()) == [2020, 2022]


def test_weather_folders_that_are_absent_or_empty_are_warnings(spark, tmp_path):
    empty, full = tmp_path / "empty", tmp_path / "full" / "2024"
    empty.mkdir()
    (empty / "zero.csv").write_text("")
    full.mkdir(parents=True)
    (full / "a.csv").write_text("Date/Time,Temp\n2024-01-01 00:00,1\n")
    found = [weather.folder_findings(spark, str(tmp_path / name)).collect() for name in ("absent", "empty", "full")]
    assert [[(r.severity, r.finding) for r in rows] for rows in found] == [[("warning", "no weather folder")], [("warning", "no weather files")], []]

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatt.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tidewatt-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """(timestamp, values...) rows, hourly from a start, from lists that may hold None."""

    def build(start="2024-01-01 00:00:00", hours=None, step_seconds=3600, keys="", **columns):
        count = len(next(iter(columns.values())))
        hours = range(count) if hours is None else hours
        names = list(columns)
        rows = [(int(h), *[None if v is None else float(v) for v in row]) for h, row in zip(hours, zip(*columns.values()))]
        schema = "h bigint, " + ", ".join(f"{n} double" for n in names)
        df = spark.createDataFrame(rows, schema)
        at = f"timestampadd(SECOND, h * {step_seconds}, timestamp_ntz'{start}') AS timestamp"
        return df.selectExpr(at, *names)

    return build

"""Names of queries, their Spark form and their SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same columns and rows in DuckDB."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, decimals: int = 6, lean: float = 0.0) -> DataFrame:
    """All doubles rounded, so that engines that add in another order still agree.

    Scaled, rounded half up and scaled back, as the SQL side does; Spark's ``round``
    goes through decimal text and may take the other side of a near tie. ``lean`` sends
    ties up even when the last bits of a sum fall short of them.
    """
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    scale = F.lit(10.0**decimals)
    return df.withColumns({c: F.floor(F.col(c) * scale + (0.5 + lean)) / scale for c in doubles}) if doubles else df

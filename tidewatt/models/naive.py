"""The value one season ago."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SeasonalNaive:
    def __init__(self, lag_column: str = "demand_lag_168h", name: str = "SeasonalNaive168"):
        self.lag_column = lag_column
        self.name = name

    def fit(self, df: DataFrame, keys: Sequence[str] = ()) -> None:
        return None

    def transform(self, df: DataFrame, params: None = None, keys: Sequence[str] = ()) -> DataFrame:
        if self.lag_column not in df.columns:
            raise ValueError(f"{self.name} needs column {self.lag_column}")
        return df.withColumn("y_hat", F.col(self.lag_column))

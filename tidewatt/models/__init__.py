"""Forecasters.

A model has a ``name``, ``fit(df, keys) -> params`` and ``transform(df, params, keys) ->
df with y_hat``; ``params`` is a DataFrame with one row per series, or None. Any object
with these three works in the back-test. A row with a missing input gets a null y_hat.
"""

from tidewatt.models.mlp import PooledMLP
from tidewatt.models.naive import SeasonalNaive
from tidewatt.models.ridge import LagRidge, LinearWeatherRidge

__all__ = ["LagRidge", "LinearWeatherRidge", "PooledMLP", "SeasonalNaive"]

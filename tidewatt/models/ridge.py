"""Ridge regression per series from one aggregate.

The training rows are reduced to their centred cross-products (k features: k(k+3)/2
sums), which Spark combines before the shuffle. What is left per series is a k x k
system; those are solved in batches on the executors. Several models are reduced together: one
aggregate over the union of their inputs, in which each model counts its own complete rows, gives one
table of parameters and needs one scan and one join, whatever the number of models. The penalty is added to the
plain sums of squares and the intercept is free, so

    (Xc'Xc + alpha I) b = Xc'yc,   intercept = mean(y) - mean(X) b.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.functions.calendar import TREND_ORIGIN, years_since
from tidewatt.operators.keyed import attach
from tidewatt.operators.metrics import complete_cases

# Fixed names: model inputs.
WEATHER_FEATURES = ["hdd_18", "cdd_18", "hour_sin", "hour_cos", "doy_sin", "doy_cos", "is_weekend"]
TREND = "years_since_2019"
LAG_FEATURES = [
    "demand_lag_1h",
    "demand_lag_24h",
    "demand_lag_168h",
    "demand_rollmean_24h",
    "demand_rollmean_168h",
]


def cross_products(
    df: DataFrame, features: Sequence[str], target: str = "y", keys: Sequence[str] = ()
) -> DataFrame:
    """Per series: n, means (features, then target) and the centred products, upper rows first.

    Only rows with all inputs and the target count.
    """
    columns = [*features, target]
    rows = complete_cases(df, features, target).select(
        *keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)]
    )
    k = len(columns)
    products = [
        F.covar_pop(f"__x{i}", f"__x{j}") * F.count("*") for i in range(k - 1) for j in range(i, k)
    ]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.array(*[F.avg(f"__x{i}") for i in range(k)]).alias("means"),
        F.array(*products).alias("products"),
    )


def solve(cross: DataFrame, k: int, alpha: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_samples, intercept, coefs) from :func:`cross_products` of ``k`` features."""
    schema = T.StructType(
        [cross.schema[c] for c in keys]
        + [
            T.StructField("n_samples", T.LongType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefs", T.ArrayType(T.DoubleType())),
        ]
    )
    key_names = list(keys)

    def solve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            out = batch[key_names].copy()
            out["n_samples"] = batch["n_samples"]
            out["intercept"], out["coefs"] = solved(batch["means"], batch["products"], k, alpha)
            yield out

    return cross.where("n_samples > 0").mapInPandas(solve_batches, schema)


def solved(means: pd.Series, products: pd.Series, k: int, alpha: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Intercept and coefficients of each row of means and centred products."""
    rows, columns = np.triu_indices(k, 0, k + 1)
    full = np.zeros((len(products), k, k + 1))
    full[:, rows, columns] = np.array(products.tolist(), dtype=float)
    gram, cross_y = full[:, :, :k], full[:, :, k]
    gram = gram + np.triu(gram, 1).transpose(0, 2, 1)
    gram[:, range(k), range(k)] += alpha
    coefs = np.linalg.solve(gram, cross_y[:, :, None])[:, :, 0]
    centre = np.array(means.tolist(), dtype=float)
    return centre[:, k] - (centre[:, :k] * coefs).sum(axis=1), list(coefs)


def masked_cross_products(
    df: DataFrame, inputs: Sequence[Sequence[str]], target: str = "y", keys: Sequence[str] = ()
) -> DataFrame:
    """Per series and for each list of inputs i: ``n_samples_i``, ``means_i``, ``products_i`` as
    :func:`cross_products` gives them, each over its own complete rows, from one aggregate."""
    union = list(dict.fromkeys([*(f for features in inputs for f in features), target]))
    place = {c: F.col(f"__x{i}") for i, c in enumerate(union)}
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(union)])
    masks = {}
    for i, features in enumerate(inputs):
        known = F.lit(True)
        for c in (*features, target):
            known = known & place[c].isNotNull()
        masks[f"__known{i}"] = known
    rows = rows.withColumns(masks)
    found = []
    for i, features in enumerate(inputs):
        known = F.col(f"__known{i}")
        # a product skips rows where either side is null, so one masked side is enough
        own = [F.when(known, place[c]) for c in (*features, target)]
        n, k = F.count_if(known), len(features)
        found += [
            n.alias(f"n_samples_{i}"),
            F.array(*[F.avg(x) for x in own]).alias(f"means_{i}"),
            F.array(*[F.covar_pop(own[a], own[b]) * n for a in range(k) for b in range(a, k + 1)]).alias(f"products_{i}"),
        ]
    return rows.groupBy(*keys).agg(*found)


def solve_together(cross: DataFrame, sizes: Sequence[int], alphas: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_samples_i, intercept_i, coefs_i) of every model i from :func:`masked_cross_products`;
    null where a model has no complete row."""
    key_names, models = list(keys), list(zip(sizes, alphas))
    fields = [("n_samples", T.LongType()), ("intercept", T.DoubleType()), ("coefs", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(
        [cross.schema[c] for c in keys] + [T.StructField(f"{n}_{i}", t) for i in range(len(models)) for n, t in fields]
    )

    def solve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            out = batch[key_names].copy()
            for i, (k, alpha) in enumerate(models):
                some = (batch[f"n_samples_{i}"] > 0).to_numpy()
                intercept, coefs = np.full(len(batch), np.nan), np.full(len(batch), None, dtype=object)
                if some.any():
                    part = batch[some]
                    intercept[some], rows = solved(part[f"means_{i}"], part[f"products_{i}"], k, alpha)
                    for at, row in zip(np.flatnonzero(some), rows):
                        coefs[at] = row
                out[f"n_samples_{i}"] = batch[f"n_samples_{i}"]
                out[f"intercept_{i}"] = np.where(some, intercept, None)
                out[f"coefs_{i}"] = coefs
            yield out

    return cross.mapInPandas(solve_batches, schema)


def linear_score(features: Sequence[str], intercept: Column, coefs: Column) -> Column:
    """intercept + sum of column * coefficient; null when an input is null."""
    score = intercept
    for i, name in enumerate(features):
        score = score + F.col(name).cast("double") * F.get(coefs, F.lit(i))
    return score


class Ridge:
    """What linear models share; a subclass names its inputs."""

    name: str
    alpha: float

    def inputs(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        raise NotImplementedError

    def fit(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        rows, features = self.inputs(df)
        return solve(cross_products(rows, features, "y", keys), len(features), self.alpha, keys)

    def transform(self, df: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """``params`` without a row for a series (or at all) gives a null forecast there."""
        rows, features = self.inputs(df)
        fitted = attach(
            rows,
            params.select(*keys, F.col("intercept").alias("__intercept"), F.col("coefs").alias("__coefs")),
            keys,
            spread_by=["timestamp"],
        )
        y_hat = linear_score(features, F.col("__intercept"), F.col("__coefs"))
        return fitted.select(*df.columns, y_hat.alias("y_hat"))

    def coefficients(self, df: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """The parameters as rows: (keys, feature, coef), the intercept among them."""
        _, features = self.inputs(df)
        named = [F.struct(F.lit("intercept").alias("feature"), F.col("intercept").alias("coef"))] + [
            F.struct(F.lit(f).alias("feature"), F.get("coefs", F.lit(i)).alias("coef"))
            for i, f in enumerate(features)
        ]
        return params.select(*keys, F.inline(F.array(*named)))


def _with_inputs(df: DataFrame, models: Sequence[Ridge]) -> tuple[DataFrame, list[list[str]]]:
    """``df`` with the inputs of all models; inputs that a model makes itself get names of their own."""
    named = []
    for i, model in enumerate(models):
        rows, features = model.inputs(df)
        made = {f: f"__{f}_of_{i}" for f in features if f not in df.columns}
        df = rows.withColumnsRenamed(made)
        named.append([made.get(f, f) for f in features])
    return df, named


def fit_together(train: DataFrame, models: Sequence[Ridge], keys: Sequence[str] = ()) -> DataFrame:
    """The parameters of all models, one row per series, from one pass over ``train``."""
    rows, inputs = _with_inputs(train, models)
    cross = masked_cross_products(rows, inputs, "y", keys)
    return solve_together(cross, [len(f) for f in inputs], [m.alpha for m in models], keys)


def transform_together(
    df: DataFrame, models: Sequence[Ridge], params: DataFrame, into: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """``df`` with a forecast of each model, from one join with their parameters."""
    rows, inputs = _with_inputs(df, models)
    names = [f"{n}_{i}" for i in range(len(models)) for n in ("intercept", "coefs")]
    table = params.select(*keys, *[F.col(n).alias(f"__{n}") for n in names])
    fitted = attach(rows, table, keys, spread_by=["timestamp"])
    scores = [linear_score(f, F.col(f"__intercept_{i}"), F.col(f"__coefs_{i}")) for i, f in enumerate(inputs)]
    return fitted.select(*df.columns, *[score.alias(name) for score, name in zip(scores, into)])


class LinearWeatherRidge(Ridge):
    """Degree days, daily and yearly cycle, weekend and a linear trend."""

    name = "LinearWeatherRidge"

    def __init__(self, alpha: float = 1.0, include_trend: bool = True, trend_origin: str = TREND_ORIGIN):
        self.alpha = alpha
        self.include_trend = include_trend
        self.trend_origin = trend_origin

    def inputs(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        missing = [f for f in WEATHER_FEATURES if f not in df.columns]
        if missing:
            raise ValueError(f"{self.name} lacks columns {missing}")
        if not self.include_trend:
            return df, list(WEATHER_FEATURES)
        trend = years_since(F.col("timestamp"), self.trend_origin)
        return df.withColumn(TREND, trend), [*WEATHER_FEATURES, TREND]


class LagRidge(Ridge):
    """Those of the lag and rolling features that the frame has."""

    name = "LagRidge"

    def __init__(self, alpha: float = 1.0, features: Sequence[str] = LAG_FEATURES):
        self.alpha = alpha
        self.features = list(features)

    def inputs(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        present = [f for f in self.features if f in df.columns]
        if not present:
            raise ValueError(f"{self.name} finds none of {self.features}")
        return df, present

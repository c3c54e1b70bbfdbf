"""Fit on the training split, score validation and test, and compare models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.models import ridge
from tidewatt.operators import metrics
from tidewatt.operators.keyed import attach, same_keys
from tidewatt.operators.quantile import exact_percentile

SCORED = ["val", "test"]
MEASURES = ["mae", "rmse", "monthly_peak_mae", "n_samples"]
HIGH_DEMAND_QUANTILE = 0.95


def high_threshold(dataset: DataFrame, keys: Sequence[str] = (), split: str | None = "split") -> DataFrame:
    """The 95th percentile of the training target, one row per series."""
    train = dataset.where(F.col(split) == "train") if split else dataset
    return exact_percentile(train, "y", HIGH_DEMAND_QUANTILE, keys, "threshold")


def predictions(dataset: DataFrame, models: Sequence, keys: Sequence[str] = (), kept: Sequence[str] = ()) -> DataFrame:
    """(model, split, keys, timestamp, y, y_hat) for the scored splits, known pairs only.

    Every model adds a column to the same scan; one expansion then makes the rows long. Linear models
    are fitted in one pass and joined once.
    """
    train = dataset.where(F.col("split") == "train")
    scored = dataset.where(F.col("split").isin(SCORED))
    linear = {i: m for i, m in enumerate(models) if isinstance(m, ridge.Ridge)}
    if linear:
        together = list(linear.values())
        params = ridge.fit_together(train, together, keys)
        scored = ridge.transform_together(scored, together, params, [f"__y_hat_{i}" for i in linear], keys)
    for i, model in enumerate(models):
        if i not in linear:
            own = model.transform(scored, model.fit(train, keys), keys)
            scored = own.withColumnRenamed("y_hat", f"__y_hat_{i}")
    long = F.inline(
        F.array(
            *[
                F.struct(F.lit(m.name).alias("model"), F.col(f"__y_hat_{i}").alias("y_hat"))
                for i, m in enumerate(models)
            ]
        )
    )
    rows = scored.select("split", *keys, "timestamp", "y", *kept, long)
    return rows.select("model", "split", *keys, "timestamp", "y", "y_hat", *kept).dropna(subset=["y", "y_hat"])


def metrics_table(preds: DataFrame, models: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per model (and series): val_* then test_*; a model without rows has null and 0."""
    errors = metrics.forecast_errors(preds, ["model", "split", *keys])
    wide = errors.groupBy("model", *keys).agg(
        *[
            F.max(F.when(F.col("split") == split, F.col(m))).alias(f"{split}_{m}")
            for split in SCORED
            for m in MEASURES
        ]
    )
    named = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    if keys:
        expected = preds.select(*keys).distinct().select(named, *[F.col(k).alias(f"__of_{k}") for k in keys])
        wide = expected.withColumnRenamed("model", "__of_model").join(wide, same_keys(["model", *keys], "__of_"), "left")
        wide = wide.drop("model", *keys).withColumnsRenamed({f"__of_{c}": c for c in ("model", *keys)})
    else:
        wide = preds.sparkSession.range(1).select(named).join(wide, "model", "left")
    counts = {f"{split}_n_samples": F.coalesce(f"{split}_n_samples", F.lit(0)) for split in SCORED}
    return wide.withColumns(counts)


def strain_tables(preds: DataFrame, threshold: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quarterly strain of every model and split; the column ``model`` tells the rows apart."""
    rows = attach(preds, threshold, keys, spread_by=["model", "timestamp"])
    return metrics.quarterly_strain(rows, F.col("threshold"), ["model", "split", *keys])


def ranking(table: DataFrame, metric: str = "test_rmse") -> DataFrame:
    return table.where(F.col(metric).isNotNull()).orderBy(metric, "model")


def prediction_table(preds: DataFrame, model: str, split: str, keys: Sequence[str] = ()) -> DataFrame:
    rows = preds.where((F.col("model") == model) & (F.col("split") == split))
    return rows.select(*keys, "timestamp", "y", "y_hat", "split")


def evaluate(dataset: DataFrame, models: Sequence, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """predictions, metrics, strain, ranking and threshold of a back-test.

    ``dataset`` is read several times (once per fit, for the threshold and for scoring):
    pass a written table or a persisted frame, not a long unwritten plan.
    """
    preds = predictions(dataset, models, keys)
    threshold = high_threshold(dataset, keys)
    table = metrics_table(preds, [m.name for m in models], keys)
    return {
        "predictions": preds,
        "threshold": threshold,
        "metrics": table,
        "strain": strain_tables(preds, threshold, keys),
        "ranking": ranking(table),
    }


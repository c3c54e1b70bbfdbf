"""A neural network regressor trained data-parallel.

One round is one Spark job: every partition of the written training table starts from the
same weights, measures their error on its rows that are kept out, and makes one pass of Adam
over the others, batch by batch, in the order of a hash; Spark then averages the resulting
weights, weighted by rows. The driver only ever holds one set of weights (a few thousand
numbers). A hash of the series time keeps a tenth of the rows out; training stops when their
squared error has not improved for more than ``patience`` rounds. If no row is kept out, the
error is that of the rows that train.

The outcome depends on the number of parts, so that is a setting, and does not follow from
the number of rows or the size of the cluster. Set it to the tasks that the training rows need.
A part is the rows whose hash falls into it, in the order of that hash, and what the parts return is
merged in the order of the parts. So the same rows and settings (Spark's Arrow batch size among them)
give the same weights to the last bit, whatever executors, retries or file splits there are.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.operators.metrics import complete_cases, feature_columns
from tidewatt.session import staged


@dataclasses.dataclass(frozen=True)
class Layout:
    """Layer sizes, and where each weight matrix and bias sits in the flat vector."""

    sizes: tuple[int, ...]

    @property
    def count(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def split(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        layers, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return layers

    def start(self, seed: int) -> np.ndarray:
        """Uniform start values with the usual bound for rectified units."""
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts.append(rng.uniform(-bound, bound, (a + 1) * b))
        return np.concatenate(parts)


def forward(layers, x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer; the last is linear."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    return out


def gradient(layout: Layout, flat: np.ndarray, x: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    """Of half the mean squared error plus half the L2 penalty per row of the batch."""
    layers = layout.split(flat)
    acts = forward(layers, x)
    n = len(x)
    delta = (acts[-1] - y[:, None]) / n
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        parts.append(np.concatenate([(acts[i].T @ delta + l2 * w / n).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ w.T) * (acts[i] > 0)
    return np.concatenate(parts[::-1])


class Adam:
    """Fixed decay rates 0.9 and 0.999, epsilon 1e-8."""

    def __init__(self, first: np.ndarray, second: np.ndarray, steps: int, rate: float):
        self.first, self.second, self.steps, self.rate = first.copy(), second.copy(), steps, rate

    def step(self, flat: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * grad
        self.second = 0.999 * self.second + 0.001 * grad * grad
        scale = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        return flat - scale * self.first / (np.sqrt(self.second) + 1e-8)


def merged_moments(a, b):
    """(rows, means, sums of squares about them) of two sets of rows together."""
    (n, mean, squares), (k, other, more) = a, b
    apart = other - mean
    return n + k, mean + apart * (k / (n + k)), squares + more + apart * apart * (n * k / (n + k))


def _in_order(c: Column) -> Column:
    """The sum of a value of each part, in the order of the parts; there are as many as the setting says."""
    values = F.array_sort(F.collect_list(F.struct("part", c.alias("v"))))
    return F.aggregate(values, F.lit(0.0), lambda total, p: total + p["v"])


def full_batch_step(
    df: DataFrame, layout: Layout, flat, features: Sequence[str], means, spreads, l2: float = 1e-4, rate: float = 1e-3, target: str = "y"
) -> DataFrame:
    """(i, n, gradient, weight): the gradient over all complete rows at the weights ``flat``, and the weights after
    Adam's first step along it. Each task adds up the gradients of its rows; ``layout.count`` numbers a task move.
    """
    state = df.sparkSession.sparkContext.broadcast((np.asarray(flat, float), np.asarray(means, float), np.asarray(spreads, float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, mean, spread = state.value
        total, n = np.zeros(layout.count), 0
        for batch in batches:
            if len(batch):
                x = (np.stack(batch["x"].to_numpy()) - mean[:-1]) / spread[:-1]
                y = (batch["y"].to_numpy() - mean[-1]) / spread[-1]
                total, n = total + len(y) * gradient(layout, weights, x, y, 0.0), n + len(y)
        if n:
            yield pd.DataFrame({"i": np.arange(layout.count), "g": total, "n": n})

    rows = complete_cases(df.withColumnRenamed(target, "y"), features)
    rows = rows.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col("y").cast("double").alias("y"))
    sums = rows.mapInPandas(run, "i int, g double, n bigint").groupBy("i").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    penalised = np.concatenate([np.repeat([l2, 0.0], [a * b, b]) for a, b in zip(layout.sizes, layout.sizes[1:])])
    start = [(i, float(w), float(p)) for i, (w, p) in enumerate(zip(flat, penalised))]
    given = df.sparkSession.createDataFrame(start, "i int, w double, penalty double")
    slope = (F.col("g") + F.col("penalty") * F.col("w")) / F.col("n")
    # the first of Adam's steps, whose averages are the gradient and its square alone
    step = F.lit(rate) * F.col("gradient") / (F.abs("gradient") + F.lit(1e-8 / np.sqrt(0.001)))
    found = sums.join(given, "i").withColumn("gradient", slope)
    return found.select("i", "n", "gradient", (F.col("w") - step).alias("weight"))


class PooledMLP:
    """One network for all series of the frame."""

    def __init__(
        self,
        hidden: Sequence[int] = (64, 32),
        l2: float = 1e-4,
        learning_rate: float = 1e-3,
        batch_size: int = 256,
        max_rounds: int = 200,
        patience: int = 10,
        min_gain: float = 1e-4,
        holdout: float = 0.1,
        seed: int = 42,
        partitions: int = 8,
        features: Sequence[str] | None = None,
        exclude: Sequence[str] = (),
        name: str = "MLPRegressor",
    ):
        self.hidden = tuple(hidden)
        self.l2 = l2
        self.learning_rate = learning_rate
        self.batch_size = batch_size
        self.max_rounds = max_rounds
        self.patience = patience
        self.min_gain = min_gain
        self.holdout = holdout
        self.seed = seed
        self.partitions = partitions
        self.features = list(features) if features else None
        self.exclude = list(exclude)
        self.name = name

    # --- training ---------------------------------------------------------------

    def fit(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """Weights, scaling and feature list as rows (see :func:`parameter_table`)."""
        features = self.features or feature_columns(df, [*self.exclude, *keys])
        written = self._training_table(df, features, keys)
        # spread once; a lost executor's share is read again from the written table
        part = F.pmod(F.col("at"), F.lit(self.partitions)).cast("int")
        table = written.repartitionById(self.partitions, part).sortWithinPartitions("at", "x", "y").persist()
        means, spreads, rows, kept_out = self._scales(table)
        if not rows:
            table.unpersist()
            raise ValueError("no complete training rows")
        layout = Layout((len(features), *self.hidden, 1))
        flat = layout.start(self.seed)
        first, second, steps = np.zeros_like(flat), np.zeros_like(flat), 0
        best, best_error, stale = flat, np.inf, 0
        for r in range(self.max_rounds + 1):
            before = flat
            flat, first, second, steps, error = self._round(table, layout, flat, first, second, steps, means, spreads, r, kept_out > 0)
            self.rounds = r
            if r == 0:  # the error of the start weights
                continue
            if error < best_error - self.min_gain:
                stale = 0
            else:
                stale += 1
            if error < best_error:
                best, best_error = before, error
            if stale > self.patience:
                break
        table.unpersist()
        return parameter_table(df.sparkSession, layout, best, features, means, spreads)

    def _training_table(self, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
        """Inputs as one array per row, spread evenly and written once for all rounds."""
        bin_ = F.pmod(F.xxhash64(F.lit(self.seed), *keys, "timestamp"), F.lit(1000))
        rows = complete_cases(df, features).select(
            F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
            F.col("y").cast("double").alias("y"),
            (bin_ < int(1000 * self.holdout)).alias("held_out"),
            F.xxhash64(F.lit(self.seed + 1), *keys, "timestamp").alias("at"),
        )
        return staged(rows, "mlp-training")

    def _scales(self, table: DataFrame):
        """Mean and spread of inputs and target over all complete rows, their number, and how many are kept out."""
        parts = self.partitions

        def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, n, out, mean, squares = None, 0, 0, 0.0, 0.0
            for batch in batches:
                if not len(batch):
                    continue
                part = int(batch["at"].iloc[0]) % parts
                rows = np.column_stack([np.stack(batch["x"].to_numpy()), batch["y"].to_numpy()])
                own = rows.mean(axis=0)
                n, mean, squares = merged_moments((n, mean, squares), (len(rows), own, ((rows - own) ** 2).sum(axis=0)))
                out += int(batch["held_out"].sum())
            if part is not None:
                yield pd.DataFrame({"part": [part], "n": [n], "kept_out": [out], "mean": [mean], "squares": [squares]})

        schema = "part int, n bigint, kept_out bigint, mean array<double>, squares array<double>"
        found = table.mapInPandas(moments, schema).orderBy("part").toPandas()
        n, mean, squares = 0, 0.0, 0.0
        for r in found.itertuples():
            n, mean, squares = merged_moments((n, mean, squares), (r.n, np.asarray(r.mean), np.asarray(r.squares)))
        if not n:
            return None, None, 0, 0
        spreads = np.sqrt(squares / n)
        return mean, np.where(spreads > 0, spreads, 1.0), n, int(found["kept_out"].sum())

    def _round(self, table, layout, flat, first, second, steps, means, spreads, number, some_kept_out):
        """The next weights and optimiser state, and the mean squared error of the weights given."""
        spark = table.sparkSession
        state = spark.sparkContext.broadcast((flat, first, second, steps, means, spreads))
        rate, l2, size, seed, parts = self.learning_rate, self.l2, self.batch_size, self.seed, self.partitions

        def local_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, m, v, t, mean, spread = state.value
            weights, optimiser = start, Adam(m, v, t, rate)
            rng = np.random.default_rng([seed, number])
            part, rows, judged, squares = 0, 0, 0, 0.0
            for batch in batches:
                if not len(batch):
                    continue
                part = int(batch["at"].iloc[0]) % parts
                x = (np.stack(batch["x"].to_numpy()) - mean[:-1]) / spread[:-1]
                y = (batch["y"].to_numpy() - mean[-1]) / spread[-1]
                out = batch["held_out"].to_numpy(bool)
                judge = out if some_kept_out else ~out
                off = forward(layout.split(start), x[judge])[-1][:, 0] - y[judge]
                judged, squares = judged + len(off), squares + float(off @ off)
                x, y = x[~out], y[~out]
                order = rng.permutation(len(y))
                for at in range(0, len(y), size):
                    pick = order[at : at + size]
                    weights = optimiser.step(weights, gradient(layout, weights, x[pick], y[pick], l2))
                rows += len(y)
            if rows or judged:
                columns = {"i": np.arange(layout.count), "w": weights, "m": optimiser.first, "v": optimiser.second}
                yield pd.DataFrame({**columns, "t": optimiser.steps, "n": rows, "s": squares, "k": judged, "part": part})

        schema = "i int, w double, m double, v double, t bigint, n bigint, s double, k bigint, part int"
        passes = table.mapInPandas(local_pass, schema)
        mean_of = [F.try_divide(_in_order(F.col(c) * F.col("n")), F.sum("n")).alias(c) for c in ("w", "m", "v")]
        totals = [F.max("t").alias("t"), _in_order(F.col("s")).alias("s"), F.sum("k").alias("k")]
        merged = passes.groupBy("i").agg(*mean_of, *totals).orderBy("i").toPandas()
        state.unpersist()
        error = merged["s"].iloc[0] / merged["k"].iloc[0] if merged["k"].iloc[0] else 0.0
        if merged["w"].isna().any():
            raise ValueError("all rows are kept out of training")
        return (merged["w"].to_numpy(), merged["m"].to_numpy(), merged["v"].to_numpy(), int(merged["t"].iloc[0]), error)

    # --- scoring ------------------------------------------------------------------

    def transform(self, df: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        layout, flat, features, means, spreads = read_parameters(params)
        return score(df, layout, flat, features, means, spreads)


def score(df: DataFrame, layout: Layout, flat, features: Sequence[str], means, spreads) -> DataFrame:
    """Add y_hat in Arrow batches; rows with a missing input get null."""
    state = df.sparkSession.sparkContext.broadcast((np.asarray(flat), np.asarray(means), np.asarray(spreads)))

    @F.pandas_udf("double")
    def network(x: pd.Series) -> pd.Series:
        weights, mean, spread = state.value
        out = np.full(len(x), np.nan)
        known = x.notna().to_numpy()
        if known.any():
            rows = (np.stack(x[known].to_numpy()) - mean[:-1]) / spread[:-1]
            out[known] = forward(layout.split(weights), rows)[-1][:, 0] * spread[-1] + mean[-1]
        return pd.Series(out)

    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull()
    inputs = F.when(complete, F.array(*[F.col(c).cast("double") for c in features]))
    y_hat = network(inputs)
    return df.withColumn("y_hat", y_hat).withColumn("y_hat", F.when(~F.isnan("y_hat"), F.col("y_hat")))


# --- parameters as a table --------------------------------------------------------


def parameter_table(
    spark: SparkSession, layout: Layout, flat: np.ndarray, features: Sequence[str], means, spreads
) -> DataFrame:
    """(part, layer, row, col, name, value): weights, biases, and scaling of inputs and target."""
    rows = []
    for i, (w, b) in enumerate(layout.split(np.asarray(flat))):
        rows += [("weight", i, r, c, None, float(w[r, c])) for r in range(w.shape[0]) for c in range(w.shape[1])]
        rows += [("bias", i, None, c, None, float(b[c])) for c in range(len(b))]
    for i, name in enumerate([*features, "y"]):
        rows.append(("mean", None, i, None, name, float(means[i])))
        rows.append(("std", None, i, None, name, float(spreads[i])))
    return spark.createDataFrame(rows, "part string, layer int, row int, col int, name string, value double")


def read_parameters(params: DataFrame):
    """Back from the table; its size is that of one network."""
    p = params.toPandas()
    means = p[p["part"] == "mean"].sort_values("row")
    spreads = p[p["part"] == "std"].sort_values("row")
    sizes, flat = [len(means) - 1], []
    for layer in sorted(p.loc[p["part"] == "weight", "layer"].unique()):
        own = p[p["layer"] == layer]
        weights = own[own["part"] == "weight"].sort_values(["row", "col"])
        biases = own[own["part"] == "bias"].sort_values("col")
        sizes.append(len(biases))
        flat += [weights["value"].to_numpy(), biases["value"].to_numpy()]
    features = means["name"].tolist()[:-1]
    return (
        Layout(tuple(int(s) for s in sizes)),
        np.concatenate(flat),
        features,
        means["value"].to_numpy(),
        spreads["value"].to_numpy(),
    )

"""Whitened embeddings from a covariance that only squares make.

A vector's entries c become integers x = floor(256 c). The covariance is taken over the
distinct x vectors. No product of two dimensions is formed: all tasks add up, exactly, the
squares of the centred value of every dimension and of the sum of every pair of dimensions, and

    2 cov(i, j) = var(i + j) - var(i) - var(j)

gives the rest. Values are centred on the integer next to the mean, what remains of the mean is
taken out of the sums as whole numbers, so each covariance is one correctly rounded division.
The d x d matrix goes to ``eigh`` on the driver; its size depends on the dimensions only.

Passes: the distinct vectors are one aggregate (equal vectors meet before the shuffle) written
as a stage; sums, squares and the check of the result read that stage; results are a narrow
pass over the rows.

Defined results: a vector that is null or holds a null, NaN or infinite entry takes no part;
nor do vectors whose length is not the one that most distinct vectors have (the longer of equally
frequent lengths). Rows with a null or repeated id get their own results. A component without
variance (one distinct vector, dependent dimensions) has null ``whitened``, and a null
``explained`` if nothing varies. ``deviation`` is null where it exceeds a long. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Context

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.llm.frames import Shared
from tidewatt.session import staged

SCALE = 256
BLOCK = 4096  # rows squared at once
SMALL = 1 << 30  # the square of a sum of two such integers fits in 64 bits
WIDE = Context(prec=60)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def narrowed(values: np.ndarray) -> np.ndarray:
    """64-bit integers where sums and squares of two cannot overflow, else Python's."""
    return values if not values.size or max(int(values.max()), -int(values.min())) < SMALL else values.astype(object)


def total(values: np.ndarray) -> list[int]:
    """Exact column sums."""
    if values.dtype == object:
        return [int(v) for v in values.sum(axis=0)]
    low = (values & 0x7FFFFFFF).sum(axis=0)
    return [(int(h) << 31) + int(v) for h, v in zip((values >> 31).sum(axis=0), low)]


def exact_sums(vectors: DataFrame, measure: Callable[[np.ndarray], list[int]]) -> list[int]:
    """``measure`` of all rows, which must be a list of sums over rows: one row a task and sum moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[int] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = measure(matrix(batch.column(0).slice(at, BLOCK)))
                sums = [a + b for a, b in zip(sums, part)] if sums else part
        if sums:
            values = pa.array([WIDE.create_decimal(v) for v in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), values], names=["number", "value"])

    rows = vectors.select("x").mapInArrow(run, "number int, value decimal(38,0)").groupBy("number").agg(F.sum("value").alias("value")).collect()  # as many as sums
    return [int(r["value"]) for r in sorted(rows)]


def squares(centre: np.ndarray) -> Callable[[np.ndarray], list[int]]:
    """Sums of each dimension's centred value, of its square, and of the squares of pairs' sums."""

    def measure(x: np.ndarray) -> list[int]:
        z = narrowed(x - centre)
        out = total(z) + total(z * z)
        for i in range(z.shape[1] - 1):
            pair = z[:, i : i + 1] + z[:, i + 1 :]
            out += total(pair * pair)
        return out

    return measure


def covariance(n: int, sums: list[int], squared: list[int], pairs: list[int]) -> np.ndarray:
    """By polarisation, from whole numbers; each entry is rounded once."""
    d = len(sums)
    own = [n * q - s * s for q, s in zip(squared, sums)]
    out, at = np.empty((d, d)), iter(pairs)
    for i in range(d):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, d):
            both = n * next(at) - (sums[i] + sums[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n * n)
    return out


@dataclass
class Whitening:
    """What turns integer vectors into components of unit variance."""

    n: int
    centre: np.ndarray  # integers next to the means
    rest: list[int]  # sums of what the centre leaves
    vectors: np.ndarray  # a column for each component
    variance: np.ndarray
    explained: list[float | None]

    def apply(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre).astype(float) - np.array([r / self.n for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variance > 0, z @ self.vectors / np.sqrt(self.variance), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, which is (n z - sum of z)^2."""
        z = x - self.centre
        most = self.n * max(abs(int(z.max())), abs(int(z.min()))) + max(map(abs, self.rest)) if z.size else 0
        if most * most * max(z.shape[1], 1) < 1 << 63:
            y = self.n * z - np.array(self.rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = z.astype(object) * self.n - np.array(self.rest, object)
        return [v if v < 1 << 63 else None for v in map(int, (y * y).sum(axis=1))]


def fit(vectors: DataFrame, components: int) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct rows of ``vectors.x``, and these rows; None if there are none."""
    distinct = staged(vectors.select("x").groupBy("x").agg(F.size("x").alias("d")), "distinct-vectors")
    found = distinct.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not found or not found[0]["d"]:
        return None
    d, n = found[0]["d"], found[0]["count"]
    distinct = distinct.where(F.col("d") == d)
    whole = exact_sums(distinct, total)
    centre = np.array([(2 * s + n) // (2 * n) for s in whole], np.int64)
    sums = exact_sums(distinct, squares(centre))
    v = covariance(n, sums[:d], sums[d : 2 * d], sums[2 * d :])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    trace = float(np.trace(v))
    variance = np.where(e[order] > trace * d * np.finfo(float).eps, e[order], 0.0)
    return Whitening(n, centre, sums[:d], u[:, order], variance, [float(x) / trace if trace else None for x in e[order]]), distinct


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, components without variance left out."""
    live = np.flatnonzero(model.variance > 0)
    k = len(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                w = model.apply(matrix(batch.column(0)))[:, live]
                sums += np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["number", "value"])

    if not k:
        return 0.0
    rows = distinct.select("x").mapInArrow(run, "number int, value double").groupBy("number").agg(F.sum("value").alias("value")).collect()  # k + k * k rows
    sums = np.array([r["value"] for r in sorted(rows)]) / model.n
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())


def whiten(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    rows = df.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), integers(F.col(vector)).alias("x"))
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([rows.schema["vec_id"], *[T.StructField(name, kind) for name, kind in fields]])
    fitted = fit(rows, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    model, distinct = fitted
    error = identity_error(model, distinct)
    sent = Shared(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            model = sent.get()
            x = matrix(batch.column(1))
            k, count = len(model.variance), len(x)
            once = np.repeat(np.arange(count), k)
            whitened = model.apply(x).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(once)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, model.n, np.int64)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(once)),
                    pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(model.explained * count, pa.float64()),
                    pa.array(np.full(count * k, error)),
                ],
                names=schema.names,
            )

    return rows.where(F.size("x") == len(model.centre)).mapInArrow(run, schema)

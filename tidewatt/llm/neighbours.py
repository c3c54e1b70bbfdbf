"""Approximate nearest neighbours by learned partitions of a neighbour graph.

Fit, on a bounded sample: the graph of nearest neighbours is cut into balanced parts (median
splits along main directions, then moves of vertices to the part where most of their
neighbours are, as far as its room allows), and a small network learns to say in which parts
the neighbours of a vector lie. Index: the network puts every vector into its most probable
part. Search: it routes a query to its most probable parts, whose vectors are ranked by the
exact inner product in double precision. A quarter of the sample is kept from the fit; the
number of parts probed is the smallest that reaches ``target`` recall there, held-out queries
against brute force over held-out vectors. A query whose parts hold too few rows for ``k``
results probes its next ones.

Equal vectors are one entry that carries its smallest ids, as many as a result can use, so
copies cost nothing. All results come from the probed parts. What the sample has in those same
parts gives a query a floor that none of its results is below, so a part returns only what may
still count. Large parts are dealt out in blocks, and so are the queries of a part; a task ranks
one block of queries against one block of vectors. No part is cut short.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those whose length is not the most frequent one; rows that repeat an id and its
vector count once; an id with several vectors asks with each, a ranking for each under that id,
and none of its rows is a candidate for them; a null id takes no part; with fewer candidates than
``k`` all are returned; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatt.llm.frames import Shared
from tidewatt.session import staged

SAMPLE = 8192
PART_ROWS = 100
MOST_PARTS = 128
HIDDEN = 128
TARGET = 0.97
CANDIDATE_BLOCK, QUERY_BLOCK = 20_000, 4_000


class Router(NamedTuple):
    """A network of one hidden layer: how probable each part is for a vector's neighbours."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum(vectors / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def best(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each vector, most probable first."""
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")[:, :n]


def nearest_of_sample(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` others with the largest inner products, for each row."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        close = x[at : at + 1024] @ x.T
        close[np.arange(len(close)), at + np.arange(len(close))] = -np.inf
        out[at : at + 1024] = np.argpartition(-close, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, passes: int = 10, slack: float = 1.1) -> np.ndarray:
    """A part for each vertex; none holds more than ``slack`` times its share."""
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for rows in groups:
            middle = x[rows] - x[rows].mean(axis=0)
            direction = np.linalg.svd(middle, full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(x.shape[1])
            order = rows[np.argsort(middle @ direction, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = halves
    for part, rows in enumerate(groups):
        label[rows] = part
    room = int(np.ceil(slack * len(x) / parts))
    degree = np.repeat(np.arange(len(x)), near.shape[1]), near.reshape(-1)
    ends = np.concatenate([degree[0], degree[1]]), np.concatenate([degree[1], degree[0]])
    for _ in range(passes):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (ends[0], label[ends[1]]), 1)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), wish] - votes[np.arange(len(x)), label]
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        free = room - np.bincount(label, minlength=parts)
        by_wish = np.argsort(wish[movers], kind="stable")
        rank = np.empty(len(movers), np.int64)
        sorted_wish = wish[movers][by_wish]
        rank[by_wish] = np.arange(len(movers)) - np.searchsorted(sorted_wish, sorted_wish)
        movers = movers[rank < free[wish[movers]]]
        if not len(movers):
            break
        label[movers] = wish[movers]
    return label


def fit(x: np.ndarray, parts: int, k: int, target: float, epochs: int = 25, batch: int = 256, rate: float = 2e-3, seed: int = 5) -> Router:
    """The router of a sample, and how many parts it must probe."""
    random = np.random.default_rng(seed)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    parts = 1 << max(0, int(np.log2(max(1, min(parts, len(x) // 16 or 1)))))
    if parts == 1:
        return Router(scale, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    kept = random.permutation(len(x))
    held, x = x[kept[: len(x) // 4]], x[kept[len(x) // 4 :]]
    near = nearest_of_sample(x, min(10, len(x) - 1))
    label = balanced_parts(x, near, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].reshape(-1)), 1.0)
    goal[np.arange(len(x)), label] += 2
    goal /= goal.sum(axis=1, keepdims=True)
    w = [random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    slope, square, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            v = x[rows] / scale
            hidden = np.maximum(v @ w[0] + w[1], 0)
            z = hidden @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = (z / z.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (error @ w[2].T) * (hidden > 0)
            step += 1
            for p, s, q, g in zip(w, slope, square, [v.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]):
                s += 0.1 * (g - s)
                q += 0.001 * (g * g - q)
                p -= rate * (s / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    router = Router(scale, *w, probes=parts)
    asked = np.arange(min(len(held), 1000))
    truth = router.best(held, 1)[:, 0][nearest_of_sample(held, min(k, len(held) - 1))[asked]]
    place = np.argsort(router.best(held[asked], parts), axis=1)  # at which probe each part is reached
    reached = np.take_along_axis(place, truth, axis=1)
    recall = np.array([(reached < n).mean() for n in range(1, parts + 1)])
    return router._replace(probes=int(np.argmax(recall >= target)) + 1)


def floors(x: np.ndarray, home: np.ndarray, queries: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its ``k``-th result cannot be below: the sample's entry at place ``k`` + 1
    (one may be its own) in the probed parts, less what rounding may change; minus infinity if there are fewer."""
    out = np.full(len(queries), -np.inf)
    if len(x) > k:
        for at in range(0, len(queries), 256):
            close = np.where(probed[at : at + 256][:, home], queries[at : at + 256] @ x.T, -np.inf)
            edge = -np.partition(-close, k, axis=1)[:, k]
            out[at : at + 256] = np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), -np.inf)
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and the length of their vectors."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda v: v != 0))
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths["width"] if widths else 1
    return rows.where(F.size("embedding") == width).dropDuplicates(["vec_id", "embedding"]), width


def search(
    vectors: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    sample: int = SAMPLE,
    part_rows: int = PART_ROWS,
    target: float = TARGET,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows, width = usable(vectors, vec_id, embedding)
    rows = staged(rows, "vectors")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)  # its own id may be one of them
    entries = staged(entries.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    count = entries.count()
    own = rows.groupBy("vec_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]  # rows of an id, none of them a candidate
    some = entries.orderBy(F.xxhash64("embedding"), "embedding").limit(sample).select("embedding").toArrow()  # bounded by its limit
    x = matrix(some.column(0).combine_chunks(), width) if some.num_rows else np.zeros((0, width))
    parts = min(MOST_PARTS, max(1, count // part_rows))
    fitted = fit(x, parts, k, target) if len(x) > 1 else Router(1.0, np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    router = Shared(spark, fitted)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                home = router.get().best(matrix(batch.column(1), width), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=["ids", "embedding", "part"])

    placed = staged(entries.select("ids", "embedding").mapInArrow(place, "ids array<bigint>, embedding array<double>, part int"), "placed")
    room = np.zeros(fitted.w2.shape[1], np.int64)
    for r in placed.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect():  # a number for each part
        room[r["part"]] = r["n"]
    kept = Shared(spark, (x, fitted.best(x, 1)[:, 0], room))

    def route(batches):
        x, home, room = kept.get()
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = matrix(batch.column(1), width)
            ranked = router.get().best(queries, len(room))
            before = np.cumsum(room[ranked], axis=1) - room[ranked]
            probe = (np.arange(len(room)) < router.get().probes) | (before < k + own)
            probed = np.zeros(ranked.shape, bool)
            np.put_along_axis(probed, ranked, probe, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(probe.sum(axis=1))]).astype(np.int32)), pa.array(ranked[probe].astype(np.int32)))
            floor = floors(x, home, queries, probed, k + own - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(floor)], names=["query_id", "embedding", "parts", "floor"])

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    routed = queries.mapInArrow(route, "query_id bigint, embedding array<double>, parts array<int>, floor double")
    asked = staged(routed.select("query_id", "embedding", "floor", F.explode("parts").alias("part")), "asked")

    def blocks(df: DataFrame, size: int):
        """How many blocks a part needs, as a column: at most one number for each part passes the driver."""
        sizes = {r["part"]: -(-r["n"] // size) for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}
        many = [(p, n) for p, n in sizes.items() if n > 1]
        out = F.lit(1)
        if many:
            table = F.create_map(*[F.lit(v) for pair in many for v in pair])
            out = F.coalesce(table[F.col("part")], F.lit(1))
        return out

    of_vectors, of_queries = blocks(placed, candidate_block), blocks(asked, query_block)
    every_block = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id", "embedding"), of_queries).cast("int")).withColumn("cb", every_block(of_vectors))
    right = placed.withColumn("cb", F.pmod(F.xxhash64("embedding"), of_vectors).cast("int")).withColumn("qb", every_block(of_queries))

    def rank(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        none = {"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not queries.num_rows or not candidates.num_rows:
            return pa.table(none)
        ids = candidates.column("ids").combine_chunks()
        begin, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        c = matrix(candidates.column("embedding").combine_chunks(), width)
        names, keys = queries.column("query_id").to_numpy(), queries.column("key").to_numpy()
        q = matrix(queries.column("embedding").combine_chunks(), width)
        floor = queries.column("floor").to_numpy()
        take = min(k + 1, len(c))
        out = []
        for at in range(0, len(q), 256):
            close = q[at : at + 256] @ c.T
            edge = np.maximum(-np.partition(-close, take - 1, axis=1)[:, take - 1], floor[at : at + 256])
            # keep ties at the edge, within rounding; scores below are summed the same way for all
            row, column = np.nonzero(close >= np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), edge)[:, None])
            score = np.einsum("ij,ij->i", q[at + row], c[column])
            sizes = begin[column + 1] - begin[column]
            entry = np.repeat(np.arange(len(row)), sizes)
            vec = flat[np.repeat(begin[column] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            other = vec != names[at + row[entry]]
            entry, vec = entry[other], vec[other]
            order = np.lexsort((vec, -score[entry], row[entry]))
            entry, vec = entry[order], vec[order]
            who = row[entry]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            best = place < k
            out.append((names[at + who[best]], keys[at + who[best]], vec[best], score[entry[best]]))
        return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(none)})

    keyed = left.withColumn("key", F.xxhash64("embedding"))
    found = keyed.groupBy("part", "qb", "cb").cogroup(right.groupBy("part", "qb", "cb")).applyInArrow(rank, "query_id bigint, key bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Questions that runs of documents ask of the whole corpus, and the answers they get back.

A pack is one row: some whole documents with all their columns as compressed Arrow bytes.
Packs ask by hashed keys. A pack sorts its distinct keys and sends each range of hashes to
the task that owns the range; the answer is a value for each key in the order sent. So a
key costs a few bytes once in each pack, however often it occurs there (a key in every
document of a corpus reaches its owner once from each pack), and an owner holds a bounded
share of all keys. Nothing passes the driver, and no key makes a task large.

Packs are written once as a table bucketed by pack, so that answers are joined to them
without moving the packs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.llm.frames import released, small_batches
from tidewatt.llm.words import slices
from tidewatt.session import stage_path

PACK = "pack bigint, size bigint, content binary"
PACK_BYTES = 4 << 20


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(content: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(content) as stream:
        return stream.read_next_batch()


def by_pack(rows: DataFrame, what: str, compression: str) -> DataFrame:
    """The rows as a written table bucketed by pack; such tables are joined without moving them."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{what}_{uuid.uuid4().hex}"
    rows.write.option("path", stage_path(spark, what)).option("compression", compression).bucketBy(buckets, "pack").saveAsTable(name)
    return spark.table(name)


def by_pack_once(rows: DataFrame, what: str) -> DataFrame:
    """``by_pack`` with the rows moved to their bucket before they are written, a file for each."""
    return by_pack(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pack"), what, "zstd")


def write_packs(docs: DataFrame, text: str, weigh: Callable[[pa.Array], int], pack_bytes: int = PACK_BYTES) -> tuple[DataFrame, int]:
    """The documents as a bucketed table of packs, and the sum of what ``weigh`` says of their texts.

    A task that is repeated draws new pack numbers, but only one attempt's rows are committed.
    """
    index = [c.lower() for c in docs.columns].index(text.lower())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, index, pack_bytes):
                row = {"pack": [uuid.uuid4().int >> 65], "size": [weigh(part.column(index))], "content": [packed(part)]}
                yield pa.RecordBatch.from_pydict(row, pa.schema([("pack", pa.int64()), ("size", pa.int64()), ("content", pa.binary())]))

    packs = by_pack(small_batches(docs).mapInArrow(lambda batches: released(pack(batches)), PACK), "packs", "none")
    return packs, packs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes begins in sorted 64-bit keys, and the end."""
    bounds = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def planes(values: np.ndarray) -> bytes:
    """64-bit integers, lowest bytes first: the high bytes are mostly zero and compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(content: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(content, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def sent(values: np.ndarray, kind: str) -> bytes:
    """Values as bytes. ``kind``: ``sorted`` (64-bit keys in order), ``whole`` (64-bit integers) or a numpy type."""
    if kind == "sorted":
        return planes(np.diff(values, prepend=np.uint64(0)))
    return planes(values) if kind == "whole" else values.astype(kind).tobytes()


def received(content: bytes, kind: str) -> np.ndarray:
    if kind == "sorted":
        return np.cumsum(from_planes(content), dtype=np.uint64)
    return from_planes(content).view(np.int64) if kind == "whole" else np.frombuffer(content, kind)


def questions(pack: int, keys: np.ndarray, owners: int, **beside: tuple[np.ndarray, str]) -> pa.RecordBatch:
    """A row for each range that holds keys: owner, pack, the sorted keys and (values, kind) beside them."""
    cuts = ranges(keys, owners)
    used = np.flatnonzero(np.diff(cuts))
    columns = {"owner": pa.array(used.astype(np.int64)), "pack": pa.array(np.full(len(used), pack, np.int64))}
    for name, (values, kind) in {"keys": (keys, "sorted"), **beside}.items():
        columns[name] = pa.array([sent(values[cuts[i] : cuts[i + 1]], kind) for i in used], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def answered(rows: DataFrame, answer: Callable[..., tuple[np.ndarray, int]], kinds: dict[str, str], reply: str = "u1") -> DataFrame:
    """(pack, owner, answer, tally): a value for each key that was asked, and a number for each owner.

    ``answer`` gets what all packs sent to one owner, by name as in ``kinds``, and gives the
    values in that order and a number; the number stands in one row of each owner.
    """

    def of_owner(table: pa.Table) -> pa.Table:
        parts = {n: [received(v.as_py(), k) for v in table.column(n)] for n, k in kinds.items()}
        sizes = [len(v) for v in next(iter(parts.values()))]
        values, tally = answer(**{n: np.concatenate(v) for n, v in parts.items()})
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        out = pa.array([sent(values[a:b], reply) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
        tallies = pa.array([tally] + [0] * (len(sizes) - 1), pa.int64())
        return pa.table({"pack": table.column("pack"), "owner": table.column("owner"), "answer": out, "tally": tallies})

    return rows.groupBy("owner").applyInArrow(of_owner, "pack bigint, owner bigint, answer binary, tally bigint")


def joined(answers: pa.Scalar, kind: str) -> np.ndarray:
    """All answers to a pack in the order of its sorted keys."""
    rows = answers.as_py() or []
    return np.concatenate([received(r["answer"], kind) for r in rows]) if rows else received(b"", kind)


def over_packs(packs: DataFrame, replies: list[tuple[DataFrame, str]], work: Callable[..., Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``work(pack, rows, *answers)`` for each pack with its answers; a pack's share of them is bounded by its size."""
    types = [t for _, t in replies]
    frame = packs.select("pack", "content")
    for k, (df, _) in enumerate(replies):
        of_pack = df.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("owner", "answer"))).alias(f"answers_{k}"))
        frame = frame.join(of_pack, "pack", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                answers = [joined(batch.column(2 + k)[i], t) for k, t in enumerate(types)]
                yield from work(batch.column(0)[i].as_py(), unpacked(batch.column(1)[i].as_py()), *answers)

    return small_batches(frame).mapInArrow(lambda batches: released(run(batches)), schema)

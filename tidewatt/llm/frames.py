"""Batches of whole rows through a function, without touching the other columns."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatt.llm.words import slices


BATCH_BYTES = 16 << 20


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then gives the system back what the allocators hold, since a worker stays for other tasks."""
    yield from batches
    del batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself. Its session hands rows to Python in batches of at most ``BATCH_BYTES`` from here on,
    since a batch of long texts is held several times over in a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = df.sparkSession.conf.get(name).rstrip("b")
    if not set_to.isdigit() or int(set_to) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, int], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``work(rows, index of the text column)`` over runs of rows of bounded text size."""
    index = [c.lower() for c in df.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, index):
                yield work(part, index)

    return small_batches(df).mapInArrow(lambda batches: released(run(batches)), schema)


def add_struct(df: DataFrame, text: str, name: str, fields: T.StructType, work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """All columns of ``df`` and a struct ``name`` that ``work`` makes from the texts."""
    names = [f.name for f in fields]

    def extend(part: pa.RecordBatch, index: int) -> pa.RecordBatch:
        made = pa.StructArray.from_arrays(work(part.column(index)), names=names)
        return pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    return map_texts(df, text, extend, T.StructType([*df.schema.fields, T.StructField(name, fields)]))


def discard(stage: DataFrame) -> None:
    """Deletes the files of a written stage that no frame reads any more."""
    jvm, conf = stage.sparkSession._jvm, stage.sparkSession._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in stage.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


class Shared:
    """A broadcast object of bounded size whose class travels with it; loaded once in a task."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.loaded: list[Any] = []

    def get(self) -> Any:
        if not self.loaded:
            self.loaded.append(pickle.loads(self.sent.value))
        return self.loaded[0]

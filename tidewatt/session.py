"""Session settings and the shared folder for written stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # naive timestamps are TIMESTAMP_NTZ; UTC keeps every remaining zoned
    # expression free of daylight-saving jumps
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture for every column expression: it doubles the time to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_local_base: str | None = None
_written: list[str] = []


def build_session(app: str = "tidewatt", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may fall back to a temporary folder of its own.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="tidewatt-")
    return _local_base


def stage_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder for one written stage."""
    path = f"{shared_folder(spark)}/tidewatt/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def remove_stages(spark: SparkSession) -> None:
    """Deletes the stages that this process wrote. Call it when no frame that reads them is in use."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a Parquet stage and read it back.

    Cuts the lineage with a table that survives the loss of executors. Use it for
    a frame that several later jobs read, not inside a single plan.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Small per-series tables (parameters, thresholds) attached to large frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Left-join one row per series onto every row of that series; null keys match each other.

    Without keys ``small`` is a single row and becomes a scalar subquery. With keys the
    join is an equi-join on (keys, salt): a series that holds a large part of the rows
    is spread over ``SALTS`` tasks, and ``small`` is repeated that often. Spark may
    still broadcast ``small`` when its size is under the session's threshold.
    """
    values = [c for c in small.columns if c not in keys]
    if not keys:
        row = small.select(F.struct(*values).alias("__row")).scalar()
        joined = df.withColumn("__row", row)
        return joined.select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in values])
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__copy")
    renamed = small.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *values, copies)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    same = same_keys(keys, "__of_") & (F.col("__salt") == F.col("__copy"))
    return df.withColumn("__salt", salt).join(renamed, same, "left").select(*df.columns, *values)


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Each key equals the column of the same name with a prefix, null with null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))

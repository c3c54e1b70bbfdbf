"""Windows over long series without one task per series.

A window partitioned by the series keys sorts a whole series in one task, and with
no keys it sorts the whole table in one. Here each series is cut into time buckets
of at most ``STEPS_PER_BUCKET`` steps and windows run per (keys, bucket). What a row
needs from outside its bucket reaches it in one of two ways:

* ``halo``: rows that later buckets look back on are copied into those buckets
  (lags, rolling means);
* carry: the first and last known value of each bucket form a small summary; what lies
  before and after each bucket is found on that summary, and those few values join the
  bucket as halo rows (interpolation, fills, gaps of any length).

The summary itself is scanned in levels (:func:`known_beyond`): its rows are cut into blocks,
the blocks are summarised in the same way, and so on, until a series fits into one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.functions.timeline import floor_micros, step_micros, to_micros

# Equal to the row count that Spark's window operator keeps in memory before it spills.
STEPS_PER_BUCKET = 4096

# Rows of a summary that one window takes of a series, at each level.
SLOTS = 4096
_YEARS = 320_000_000_000_000_000  # microseconds that the years 1 to 9999 fit into

AT = "__at"  # microseconds since 1970
BUCKET = "__bucket"  # microseconds at the start of the bucket
OWN = "__own"  # false for a halo copy
_BLOCK = "__block"


def into_buckets(
    df: DataFrame,
    ts: str,
    freq: str,
    steps: int | None = STEPS_PER_BUCKET,
    halo: int = 0,
) -> DataFrame:
    """Add the bucket columns; with ``halo`` copy rows into the buckets of the next steps.

    ``steps=None`` puts each series into one bucket: fewer operators, for series that
    are known to be short.
    """
    df = df.withColumn(AT, to_micros(ts))
    if steps is None:
        return df.withColumns({BUCKET: F.lit(0).cast("long"), OWN: F.lit(True)})
    step = step_micros(freq)
    width = step * steps
    home = floor_micros(AT, width)
    if not halo:
        return df.withColumns({BUCKET: home, OWN: F.lit(True)})
    reach = floor_micros(F.col(AT) + halo * step, width)
    return df.withColumn(
        BUCKET, F.explode(F.sequence(home, reach, F.lit(width)))
    ).withColumn(OWN, F.col(BUCKET) == home)


def bucket_width(freq: str, steps: int | None) -> int | None:
    """Microseconds of a bucket; None if each series is one."""
    return None if steps is None else step_micros(freq) * steps


def out_of_buckets(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(AT, BUCKET, OWN)


def bucket_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, BUCKET).orderBy(AT)


class Known:
    """Nearest known values of a column around a row, as columns of the frame."""

    def __init__(self, name: str):
        self.name = name
        self.before_at = F.col(f"__{name}_pt")
        self.before = F.col(f"__{name}_pv")
        self.after_at = F.col(f"__{name}_nt")
        self.after = F.col(f"__{name}_nv")

    def temporary(self) -> list[str]:
        return [f"__{self.name}_{tag}" for tag in ("pt", "pv", "nt", "nv")]

    def interpolated(self, at: Column) -> Column:
        """On the line between the neighbours; after the last known value, that value."""
        share = (at - self.before_at) / (self.after_at - self.before_at)
        inside = self.before + (self.after - self.before) * share
        return (
            F.when(self.before.isNull(), F.lit(None).cast("double"))
            .when(self.after.isNull(), self.before)
            .when(self.before_at == at, self.before)
            .otherwise(inside)
        )

    def filled(self, at: Column) -> Column:
        """Interpolated, then last value forward, then first value backward."""
        return F.coalesce(self.interpolated(at), self.before, self.after)


def with_known(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """For each column: the last known value at or before the row, the first one after it.

    ``df`` comes from :func:`into_buckets`, whose buckets span ``width`` microseconds; None says that
    each series is one bucket, so that nothing has to be carried.
    """
    if width is not None:
        df = df.unionByName(_carried_rows(df, columns, keys, width), allowMissingColumns=True)
    over = f"OVER (PARTITION BY {', '.join(_quoted(k) for k in [*keys, BUCKET])} ORDER BY {AT})"
    known = {}
    for c in columns:
        name = _quoted(c)
        at = f"CASE WHEN {name} IS NOT NULL THEN {AT} END"
        # offset functions that skip nulls need one ascending sort for both directions
        known[f"__{c}_pt"] = F.expr(f"coalesce({at}, lag({at}, 1) IGNORE NULLS {over})")
        known[f"__{c}_pv"] = F.expr(f"coalesce({name}, lag({name}, 1) IGNORE NULLS {over})")
        known[f"__{c}_nt"] = F.expr(f"lead({at}, 1) IGNORE NULLS {over}")
        known[f"__{c}_nv"] = F.expr(f"lead({name}, 1) IGNORE NULLS {over}")
    return df.withColumns(known)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _carried_rows(df: DataFrame, columns: Sequence[str], keys: Sequence[str], width: int) -> DataFrame:
    """For each bucket up to two halo rows per column: the last known value of all earlier
    buckets and the first one of all later buckets, at their own times."""
    edges = []
    for c in columns:
        at = _at_if_known(c)
        edges += [
            F.min(at).alias(f"__first_t_{c}"),
            F.min_by(c, at).alias(f"__first_v_{c}"),
            F.max(at).alias(f"__last_t_{c}"),
            F.max_by(c, at).alias(f"__last_v_{c}"),
        ]
    around = known_beyond(df.where(OWN).groupBy(*keys, BUCKET).agg(*edges), columns, keys, width)
    halo = [
        F.struct(
            F.col(f"__{side}_t_{c}").alias(AT),
            *[
                (F.col(f"__{side}_v_{c}") if o == c else F.lit(None).cast(df.schema[o].dataType)).alias(o)
                for o in columns
            ],
        )
        for c in columns
        for side in ("before", "after")
    ]
    return (
        around.select(*keys, BUCKET, F.explode(F.array(*halo)).alias("__row"))
        .select(*keys, BUCKET, F.lit(False).alias(OWN), "__row.*")
        .where(F.col(AT).isNotNull())
    )


def known_beyond(
    summary: DataFrame, columns: Sequence[str], keys: Sequence[str], width: int, slots: int | None = None
) -> DataFrame:
    """(keys, BUCKET, __before_t_c, __before_v_c, __after_t_c, __after_v_c): the nearest known time and
    value of each column before and after each bucket.

    ``summary`` has a row for each bucket of ``width`` microseconds that has rows, with the first and last
    known time and value (``__first_t_c`` ... ``__last_v_c``). In place of the last it may have those of the
    bucket's head and of its tail: the next bucket then holds copies of the tail, and only the head counts for it.

    A window takes at most ``slots`` buckets of a series. A longer span is cut into blocks of as many
    buckets; a block is a wider bucket, whose last slot is copied into the next block, so the same
    question is asked of the blocks, and their answers enter each block as its outermost rows.
    """
    slots = SLOTS if slots is None else slots
    wide = width * slots
    if wide >= _YEARS:
        rows = _with_ends(summary.withColumns({_BLOCK: F.pmod(BUCKET, F.lit(1)), OWN: F.lit(True)}), columns)
    else:
        rows = _in_blocks(summary, columns, keys, width, slots)
    up = Window.partitionBy(*keys, _BLOCK).orderBy(BUCKET)
    down = Window.partitionBy(*keys, _BLOCK).orderBy(F.col(BUCKET).desc())
    adjoins = F.lag(BUCKET, 1).over(up) == F.col(BUCKET) - width
    found = {}
    for c in columns:
        for part in ("t", "v"):
            last = F.col(f"__last_{part}_{c}")
            nearest = F.when(adjoins, F.lag(f"__head_{part}_{c}", 1).over(up)).otherwise(F.lag(last, 1).over(up))
            earlier = F.last(last, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -2))
            before = F.coalesce(nearest, earlier)
            after = F.last(f"__first_{part}_{c}", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
            found |= {f"__before_{part}_{c}": before, f"__after_{part}_{c}": after}
    return rows.withColumns(found).where(OWN).select(*keys, BUCKET, *found)


def _in_blocks(summary: DataFrame, columns: Sequence[str], keys: Sequence[str], width: int, slots: int) -> DataFrame:
    """The summary in blocks, the last slot of each also in the next one, and in each block two rows with what is
    known before that copy and after the block."""
    wide = width * slots
    home = floor_micros(BUCKET, wide)
    copied = F.col(BUCKET) - home == wide - width
    ends = []
    for c in columns:
        first, last = F.col(f"__first_t_{c}"), _last_of(summary, "t", c)
        for name, known, source, time, pick in (
            ("first", first, F.col(f"__first_v_{c}"), F.min, F.min_by),
            ("head", F.when(~copied, last), _last_of(summary, "v", c), F.max, F.max_by),
            ("tail", F.when(copied, last), _last_of(summary, "v", c), F.max, F.max_by),
        ):
            ends += [time(known).alias(f"__{name}_t_{c}"), pick(source, known).alias(f"__{name}_v_{c}")]
    blocks = summary.groupBy(*keys, home.alias(_BLOCK)).agg(*ends).withColumnRenamed(_BLOCK, BUCKET)
    outer = known_beyond(blocks, columns, keys, wide, slots).withColumnRenamed(BUCKET, _BLOCK)
    sides = []
    for at, full, side in ((F.col(_BLOCK) - 2 * width, "last", "before"), (F.col(_BLOCK) + wide, "first", "after")):
        held = [at.alias(BUCKET)]
        for name in ("first", "last"):
            for part in ("t", "v"):
                for c in columns:
                    kind = summary.schema[f"__first_{part}_{c}"].dataType
                    value = F.col(f"__{side}_{part}_{c}") if name == full else F.lit(None).cast(kind)
                    held.append(value.alias(f"__{name}_{part}_{c}"))
        sides.append(F.struct(*held))
    edges = outer.select(*keys, _BLOCK, F.lit(False).alias(OWN), F.inline(F.array(*sides)))
    both = F.when(copied, F.array(home, home + wide)).otherwise(F.array(home))
    dealt = summary.withColumn(_BLOCK, F.explode(both)).withColumn(OWN, F.col(_BLOCK) == floor_micros(BUCKET, wide))
    return _with_ends(dealt, columns).unionByName(edges, allowMissingColumns=True)


def _last_of(summary: DataFrame, part: str, c: str) -> Column:
    parts = [f"__{name}_{part}_{c}" for name in ("tail", "head", "last")]
    return F.coalesce(*[F.col(name) for name in parts if name in summary.columns])


def _with_ends(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The head and the last of each bucket. Made here and not in the summary, since the blocks read that too, and
    only the same aggregate shares its shuffle."""
    ends = {}
    for c in columns:
        for part in ("t", "v"):
            last = _last_of(rows, part, c)
            # without a tail nothing is copied into the next bucket, so all of this one counts for it
            head = F.col(f"__head_{part}_{c}") if f"__head_{part}_{c}" in rows.columns else last
            ends |= {f"__head_{part}_{c}": head, f"__last_{part}_{c}": last}
    return rows.withColumns(ends).drop(*[f"__tail_{part}_{c}" for part in ("t", "v") for c in columns])


def _at_if_known(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.col(AT))

"""Fills, lags and rolling means of long series on one bucketed frame.

Series are cut into buckets as everywhere; a bucket also holds a copy of the last ``reach`` steps of
the bucket before it, so lags and means find their rows. What those copies and the bucket's own
rows need from farther away, the nearest known values before the copies and after the bucket, comes as
two edge rows that sort first and last. So values are filled in the bucket that uses them, the copies
too, and filling, looking back and the search for holes share one shuffle of the rows. Beside
them moves only the summary of the buckets, from the columns it needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.functions.timeline import floor_micros, step_micros, to_micros
from tidewatt.operators.buckets import AT, BUCKET, OWN, STEPS_PER_BUCKET, Known, bucket_window, known_beyond

EDGE = "__edge"  # of an edge row: for each column the time and value known beyond the bucket
FIRST, LAST = -(1 << 62), 1 << 62
SEEN = "__seen"


def fill_and_look_back(
    df: DataFrame,
    fills: Sequence[str],
    value: str,
    lags: Mapping[str, int],
    means: Mapping[str, int],
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
    steps: int | None = STEPS_PER_BUCKET,
) -> DataFrame:
    """``df`` with the columns ``fills`` filled (linear in time, then forward, then backward), the
    values of ``value`` ``k`` rows back, and means of its ``n`` rows before the current one.

    Rows must be steps: a hole of any length or a repeated time is an error (``contracts.gaps`` lists
    them, ``grid.regularise`` closes them). A mean skips nulls, needs one value and is
    null on the first row.

    Means come from running sums inside the bucket, whatever their length: a sliding
    frame would add up all ``n`` values again for every row. So that a difference of
    running sums loses nothing, each value is split into a multiple of a small power of
    two, whose sums are exact, and a tiny rest.
    """
    reach = max([0, *lags.values(), *means.values()])
    step = step_micros(freq)
    carried = [SEEN, *fills]
    rows = df.withColumn(AT, to_micros(ts))
    if steps is None:
        rows = rows.withColumns({BUCKET: F.lit(0).cast("long"), OWN: F.lit(True), SEEN: F.col(AT)})
    else:
        rows = with_edges(rows.withColumn(SEEN, F.col(AT)), carried, keys, step, max(steps, 8 * reach, 1), reach)
    rows = _filled(rows, fills, keys, steps is not None).withColumn("__since", _since(ts, step, keys, steps is not None))
    rows = rows.withColumns({name: F.lag(value, k).over(bucket_window(keys)) for name, k in lags.items()})
    rows = _with_means(rows, value, means, keys)
    return rows.where(F.col(OWN) & (F.col("__since").isNull() | (F.col("__since") > 0))).select(*df.columns, *lags, *means)


def with_edges(rows: DataFrame, carried: Sequence[str], keys: Sequence[str], step: int, steps: int, reach: int) -> DataFrame:
    """The rows (with AT, and SEEN equal to it) in their buckets, the last ``reach`` steps of each bucket in the next
    one too, and two edge rows in each."""
    width = step * steps
    home = floor_micros(AT, width)
    copied = F.col(AT) - home >= width - reach * step
    edges = _edges(rows, carried, keys, home, copied, width)
    both = F.when(copied, F.array(home, home + width)).otherwise(F.array(home))
    dealt = rows.withColumn(BUCKET, F.explode(both)).withColumns({OWN: F.col(BUCKET).eqNullSafe(floor_micros(AT, width))})
    return dealt.unionByName(edges, allowMissingColumns=True)


def _edges(rows: DataFrame, carried: Sequence[str], keys: Sequence[str], home: Column, copied: Column, width: int) -> DataFrame:
    """(keys, BUCKET, AT, OWN, EDGE): before and after each bucket the nearest known values that it holds no copy of."""
    found = []
    for c in carried:
        known = F.col(c).isNotNull()
        at, head, tail = (F.when(cond, F.col(AT)) for cond in (known, known & ~copied, known & copied))
        for name, known_at, time, pick in (("first", at, F.min, F.min_by), ("head", head, F.max, F.max_by), ("tail", tail, F.max, F.max_by)):
            found += [time(known_at).alias(f"__{name}_t_{c}"), pick(c, known_at).alias(f"__{name}_v_{c}")]
    summary = rows.groupBy(*keys, home.alias(BUCKET)).agg(*found)
    known = known_beyond(summary, carried, keys, width)

    def place(side: str, c: str) -> Column:
        time = F.col(f"__{side}_t_{c}")
        return F.when(time.isNotNull(), F.struct(time.alias("t"), F.col(f"__{side}_v_{c}").alias("v")))

    sides = [
        F.struct(F.lit(at).alias(AT), F.struct(*[place(side, c).alias(c) for c in carried]).alias(EDGE))
        for at, side in ((FIRST, "before"), (LAST, "after"))
    ]
    return known.select(*keys, BUCKET, F.lit(False).alias(OWN), F.inline(F.array(*sides)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _filled(rows: DataFrame, fills: Sequence[str], keys: Sequence[str], edged: bool) -> DataFrame:
    """The columns of ``fills`` without nulls, as far as the series knows any value of them."""
    if not fills:
        return rows
    sources, known = {}, {}
    # offset functions that skip nulls need one ascending sort for both directions
    over = f"OVER (PARTITION BY {', '.join(_quoted(k) for k in [*keys, BUCKET])} ORDER BY {AT})"
    for c in fills:
        time, seen = F.when(F.col(c).isNotNull(), F.col(AT)), F.col(c)
        sources[f"__{c}_t"] = F.coalesce(time, F.col(EDGE)[c]["t"]) if edged else time
        sources[f"__{c}_v"] = F.coalesce(seen, F.col(EDGE)[c]["v"]) if edged else seen
        pt, pv, nt, nv = Known(c).temporary()
        for before, after, source in ((pt, nt, _quoted(f"__{c}_t")), (pv, nv, _quoted(f"__{c}_v"))):
            known[before] = F.expr(f"coalesce({source}, lag({source}, 1) IGNORE NULLS {over})")
            known[after] = F.expr(f"lead({source}, 1) IGNORE NULLS {over}")
    filled = {c: F.when(F.col(AT).between(FIRST + 1, LAST - 1), F.coalesce(F.col(c), Known(c).filled(F.col(AT)))) for c in fills}
    return rows.withColumns(sources).withColumns(known).withColumns(filled).drop(*known, *sources)


def since_previous(keys: Sequence[str], edged: bool = True) -> Column:
    """Microseconds since the row before it in the series, null on the first."""
    seen = F.coalesce(F.col(SEEN), F.col(EDGE)[SEEN]["t"]) if edged else F.col(SEEN)
    return F.col(SEEN) - F.lag(seen, 1).over(bucket_window(keys))


def _since(ts: str, step: int, keys: Sequence[str], edged: bool) -> Column:
    """The same, with an error for anything but a step."""
    since = since_previous(keys, edged)
    hole = F.raise_error(F.concat(F.lit("not a complete grid before "), F.col(ts).cast("string"))).cast("long")
    return F.when(since != step, hole).otherwise(since)


def _with_means(rows: DataFrame, value: str, means: Mapping[str, int], keys: Sequence[str]) -> DataFrame:
    if not means:
        return rows
    ordered, whole = bucket_window(keys), Window.partitionBy(*keys, BUCKET)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, -1)
    bits = F.ceil(F.log2(F.max(F.abs(value)).over(whole) * F.count(value).over(whole)))
    rows = rows.withColumn("__unit", F.coalesce(F.pow(F.lit(2.0), bits - 51), F.lit(1.0)))
    coarse = F.rint(F.col(value) / F.col("__unit")) * F.col("__unit")
    rows = rows.withColumns({"__coarse": coarse, "__rest": F.col(value) - coarse})
    sums = {f"{part}_sum": F.sum(part).over(so_far) for part in ("__coarse", "__rest")}
    rows = rows.withColumns({**sums, "__known": F.count(value).over(so_far)})

    def last(n: int, c: str, zero) -> Column:
        return F.col(c) - F.coalesce(F.lag(c, n).over(ordered), F.lit(zero))

    return rows.withColumns(
        {
            name: F.try_divide(last(n, "__coarse_sum", 0.0) + last(n, "__rest_sum", 0.0), last(n, "__known", 0))
            for name, n in means.items()
        }
    )

"""Exact percentiles with linear interpolation, without collecting a group.

``percentile`` keeps every distinct value of a group in one task, and a ranking window sorts
them in one. Here

1. a quantile sketch (bounded size, merged before the shuffle) brackets the wanted ranks;
2. values are counted: those outside the brackets in a few totals, those inside by value. The
   counts are a written table, the only rows that are shuffled, about 0.1 % of the values;
3. ranks are refined on integers that order as the doubles do: counts by leading bits of
   the bracket tell which bin holds the rank, and only that bin is counted again, by its next bits,
   until it holds one value. A round sends at most ``2 ** (BITS + 1)`` sums a rank to one place, whatever
   the values are, and 64 bits end after seven rounds; two are usual.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.operators.keyed import attach
from tidewatt.session import staged

# The sketch is off by at most 1/ACCURACY of the rows. A bracket is the narrowest of these that
# has CLEAR rows on both sides of the rank, beside that error; the last one holds the whole group.
ACCURACY = 10_000
MARGINS = (4 / ACCURACY, 1 / 100, 1 / 8, 1.0)
CLEAR = 4
BITS = 11
_INFINITE = 2047 << 52


def order_key(v: Column) -> Column:
    """A long that orders as the double does: sign, exponent and fraction. Both zeros are 0; NaN comes last."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    two = F.lit(2.0)
    # the logarithm is rounded, so it may miss by one next to a power of two
    power = F.when(size >= F.pow(two, power + 1), power + 1).when(size < F.pow(two, power), power - 1).otherwise(power)
    normal = (power + 1022) * F.lit(1 << 52) + (size * F.pow(two, -power) * float(1 << 52)).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    whole = (
        F.when(F.isnan(v), F.lit(_INFINITE + 1))
        .when(size == 0, F.lit(0))
        .when(size == float("inf"), F.lit(_INFINITE))
        .when(size < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return F.when(v < 0, -whole).otherwise(whole).cast("long")


def exact_percentiles(df: DataFrame, value: str, quantiles: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group with non-null values (without keys always one): a column for each quantile."""
    for p in quantiles.values():
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"quantile out of range: {p}")
    ps = sorted(set(quantiles.values()))
    v = F.col("__v")
    values = df.select(*keys, F.col(value).cast("double").alias("__v")).where(v.isNotNull())
    ends = [e for m in MARGINS for p in ps for e in (max(0.0, p - m), min(1.0, p + m))]
    sketch = values.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__all"))
    width, chosen = 2 * len(ps), F.lit(len(MARGINS) - 1)
    for i in reversed(range(len(MARGINS) - 1)):
        chosen = F.when(F.col("__n") * MARGINS[i] >= CLEAR, i).otherwise(chosen)
    bracket = staged(sketch.select(*keys, F.slice("__all", chosen * width + 1, F.lit(width)).alias("__ends")), "brackets")
    counts = staged(_counts(attach(values, bracket, keys, ["__v"]), ps, keys), "counts")
    cells = counts.where("__inside IS NOT NULL").select(*keys, order_key(F.col("__inside")).alias("__k"), F.col("__inside").alias("__v"), "__n")

    wanted = _targets(counts, bracket, ps, keys)
    found: list[DataFrame] = []
    while True:
        wanted = staged(_refined(cells, wanted, keys), "ranks")
        found.append(wanted.where("__lo = __hi"))
        wanted = wanted.where("__lo < __hi")
        if wanted.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, found)

    def at(i: int, side: int) -> Column:
        return F.max(F.when(F.col("__t") == 2 * i + side, v))

    part = [F.max(F.when(F.col("__t") == 2 * i, F.col("__part"))) for i in range(len(ps))]
    interpolated = {p: at(i, 0) + (at(i, 1) - at(i, 0)) * part[i] for i, p in enumerate(ps)}
    return rows.groupBy(*keys).agg(*[interpolated[p].alias(name) for name, p in quantiles.items()])


def exact_percentile(
    df: DataFrame, value: str, p: float, keys: Sequence[str] = (), name: str = "threshold"
) -> DataFrame:
    """One row per group: the ``p`` quantile of the non-null values (without keys null if there are none)."""
    return exact_percentiles(df, value, {name: p}, keys)


def _counts(rows: DataFrame, ps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, __under, __inside, __n): rows by value inside a bracket, together outside; ``__under`` tells how
    many brackets begin above them."""
    v, under, inside = F.col("__v"), F.lit(0), F.lit(False)
    for i in range(len(ps)):
        low, high = F.col("__ends")[2 * i], F.col("__ends")[2 * i + 1]
        under = under + (v < low).cast("int")
        inside = inside | v.between(low, high)
    return rows.groupBy(*keys, under.alias("__under"), F.when(inside, v).alias("__inside")).agg(F.count("*").alias("__n"))


def _targets(counts: DataFrame, bracket: DataFrame, ps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, __t, __rank, __part, __before, __lo, __hi): the ranks below and above each quantile, the rows
    before its bracket, and the bracket's ends as keys."""
    totals = [F.sum(F.when(F.col("__under") >= len(ps) - i, F.col("__n")).otherwise(0)).alias(f"__before_{i}") for i in range(len(ps))]
    groups = attach(bracket, counts.groupBy(*keys).agg(F.sum("__n").alias("__rows"), *totals), keys, ["__ends"])
    targets = []
    for i, p in enumerate(ps):
        place = (F.col("__rows") - 1) * F.lit(p)
        for side, rank in enumerate((F.floor(place), F.ceil(place))):
            targets.append(
                F.struct(
                    F.lit(2 * i + side).alias("__t"),
                    rank.cast("long").alias("__rank"),
                    (place - F.floor(place)).alias("__part"),
                    F.col(f"__before_{i}").alias("__before"),
                    order_key(F.col("__ends")[2 * i]).alias("__lo"),
                    order_key(F.col("__ends")[2 * i + 1]).alias("__hi"),
                )
            )
    return groups.where("__ends IS NOT NULL").select(*keys, F.inline(F.array(*targets)))


def _refined(cells: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The targets with the range of the bin that holds their rank, and its least value as ``__v``."""
    each = F.struct("__t", "__rank", "__part", "__before", "__lo", "__hi")
    wide = targets.groupBy(*keys).agg(F.collect_list(each).alias("__targets"))  # two for each quantile
    met = attach(cells, wide, keys, ["__k"]).where("__targets IS NOT NULL")
    met = met.select(*keys, "__k", "__v", "__n", F.inline("__targets")).where("__k BETWEEN __lo AND __hi")
    span = F.col("__hi").cast("double") - F.col("__lo").cast("double") + 1
    met = met.withColumn("__shift", F.greatest(F.ceil(F.log2(span)) - BITS, F.lit(0)).cast("int"))
    place = F.expr("shiftright(__k, __shift) - shiftright(__lo, __shift)").alias("__bin")
    same = ["__t", "__rank", "__part", "__before"]
    bins = met.groupBy(*keys, *same, place).agg(
        F.sum("__n").alias("n"), F.min("__k").alias("lo"), F.max("__k").alias("hi"), F.min("__v").alias("v")
    )
    lists = bins.groupBy(*keys, *same).agg(F.array_sort(F.collect_list(F.struct("__bin", "n", "lo", "hi", "v"))).alias("__bins"))
    hit = F.expr(
        """aggregate(__bins, named_struct('upto', __before, 'before', -1L, 'lo', 0L, 'hi', 0L, 'v', 0D),
             (a, b) -> CASE WHEN a.before < 0 AND __rank >= a.upto AND __rank < a.upto + b.n
               THEN named_struct('upto', a.upto + b.n, 'before', a.upto, 'lo', b.lo, 'hi', b.hi, 'v', b.v)
               ELSE named_struct('upto', a.upto + b.n, 'before', a.before, 'lo', a.lo, 'hi', a.hi, 'v', a.v) END)"""
    )
    missed = F.raise_error(F.lit("quantile sketch missed the wanted rank")).cast("long")
    found = lists.withColumn("__hit", hit)
    before = F.when(F.col("__hit.before") < 0, missed).otherwise(F.col("__hit.before"))
    return found.select(
        *keys, "__t", "__rank", "__part", before.alias("__before"), F.col("__hit.lo").alias("__lo"), F.col("__hit.hi").alias("__hi"), F.col("__hit.v").alias("__v")
    )


def rough_percentile(
    df: DataFrame, value: str, p: float, keys: Sequence[str] = (), name: str = "threshold"
) -> DataFrame:
    """The sketch alone: one pass, a value whose rank is within 1/ACCURACY of the wanted one."""
    return df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), p, ACCURACY).alias(name))

"""Data-quality rules. A rule is a frame of violations; none means the data passes.

``report`` puts several rules into one frame, ``enforce`` raises on errors.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.functions.timeline import step_micros, to_micros
from tidewatt.operators import metrics
from tidewatt.operators.buckets import AT, BUCKET, OWN, STEPS_PER_BUCKET, bucket_window
from tidewatt.operators.grid import on_grid
from tidewatt.operators.joins import missing_from
from tidewatt.operators.lookback import SEEN, since_previous, with_edges
from tidewatt.operators.windows import with_previous_time

# Fixed names: columns each table must have.
DEMAND_COLUMNS = ["timestamp", "ontario_demand_mw", "market_demand_mw", "source_file", "is_imputed"]
WEATHER_COLUMNS = [
    "timestamp",
    "temp_c",
    "dewpoint_c",
    "rel_hum_pct",
    "wind_spd_kmh",
    "precip_mm",
    "stn_press_kpa",
    "source_file",
    "is_imputed_weather",
]
MODEL_COLUMNS = [
    "timestamp",
    "y",
    "split",
    "hdd_18",
    "cdd_18",
    "demand_lag_1h",
    "demand_lag_24h",
    "demand_lag_168h",
    "demand_rollmean_24h",
    "demand_rollmean_168h",
]
EXAMPLES = 5
TOLERANCE_SECONDS = 1.0


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, required: Sequence[str], name: str = "table") -> DataFrame:
    """Checks the schema only; starts no job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"{name} lacks columns {missing}; it has {df.columns}")
    return df


def gaps(
    df: DataFrame,
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
    tolerance_seconds: float = TOLERANCE_SECONDS,
    **how,
) -> DataFrame:
    """Rows whose distance to the row before is not one step: ``gap`` or ``overlap``."""
    expected = step_micros(freq) / 1_000_000
    off = F.col("gap_seconds") - F.lit(expected)
    return (
        with_previous_time(df.select(*keys, ts), ts, keys, freq, **how)
        .where(F.abs(off) > tolerance_seconds)
        .withColumn("kind", F.when(off > 0, F.lit("gap")).otherwise(F.lit("overlap")))
    )


def off_grid(df: DataFrame, ts: str = "timestamp", freq: str = "1 hour") -> DataFrame:
    """Rows that no grid step matches, so that a re-index leaves them out."""
    return df.where(~F.coalesce(on_grid(F.col(ts), freq), F.lit(False)))


def nulls_in(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def bad_hours(df: DataFrame, hour: str = "Hour") -> DataFrame:
    """Hours that are not a whole number from 1 to 24."""
    return df.where(~F.coalesce(F.col(hour).between(1, 24), F.lit(False)))


def never_observed(df: DataFrame, column: str = "temp_c", keys: Sequence[str] = ()) -> DataFrame:
    """Series in which the column has no value at all (one row without keys)."""
    return df.groupBy(*keys).agg(F.count(column).alias("observed")).where("observed = 0")


def all_null_columns(df: DataFrame) -> DataFrame:
    return metrics.null_rates(df).where("all_null").select("column")


def split_labels(
    df: DataFrame,
    train_years: Sequence[int],
    val_year: int,
    test_year: int,
    ts: str = "timestamp",
    split: str = "split",
) -> DataFrame:
    """Labels other than the three; no train row in the train years; no val row in the val
    year; the test year present without a test row."""
    seen = df.groupBy(F.col(split).alias("split"), F.year(ts).alias("year")).agg(F.count("*").alias("n"))
    label = F.col("split")
    in_split = {s: label == s for s in metrics.SPLITS}
    facts = seen.agg(
        F.count_if(~F.coalesce(label.isin(metrics.SPLITS), F.lit(False))).alias("unknown"),
        F.count_if(in_split["train"] & F.col("year").isin(*train_years)).alias("train"),
        F.count_if(in_split["val"] & (F.col("year") == val_year)).alias("val"),
        F.count_if(F.col("year") == test_year).alias("test_year_rows"),
        F.count_if(in_split["test"] & (F.col("year") == test_year)).alias("test"),
    )
    return facts.select(
        F.inline(
            F.array(
                _finding("invalid split label", F.col("unknown") > 0),
                _finding("train split misses its years", F.col("train") == 0),
                _finding("val split misses its year", F.col("val") == 0),
                _finding("test split misses its year", (F.col("test_year_rows") > 0) & (F.col("test") == 0)),
            )
        )
    ).where("violated").select("rule")


def _finding(rule: str, violated: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), violated.alias("violated"))


def missing_years(df: DataFrame, start_year: int, end_year: int, ts: str = "timestamp") -> DataFrame:
    years = df.sparkSession.range(start_year, end_year + 1).select(F.col("id").cast("int").alias("year"))
    return missing_from(years, df.groupBy(F.year(ts).alias("year")).count(), ["year"])


def short_years(
    df: DataFrame, year: int, full: int = 8760, keys: Sequence[str] = (), ts: str = "timestamp"
) -> DataFrame:
    """The year is present with fewer rows than a full one: a warning, partial years are fine."""
    return metrics.rows_per_year(df, keys, ts).where((F.col("year") == year) & (F.col("row_count") < full))


def small_split(df: DataFrame, split: str = "test", least: int = 8000, keys: Sequence[str] = ()) -> DataFrame:
    return metrics.split_shares(df, keys).where((F.col("split") == split) & (F.col("row_count") < least))


def example(*columns: str | Column) -> Column:
    """How a violation is shown: its columns as JSON, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def accumulated(entries: DataFrame, by_example: Sequence[str] = ()) -> DataFrame:
    """(rule, example, violations, examples) of parts of (rule, example, n), which have to be merged by
    rule: the sum of n and the ``EXAMPLES`` smallest examples, n times each at most. Rules of
    ``by_example`` keep a row for each example instead, without a list."""
    apart = set(by_example)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str | None], int] = {}
        few: dict[str, list[str]] = {}

        def out() -> pa.RecordBatch:
            rows = [(rule, shown, n, [] if rule in apart else few.get(rule, [])) for (rule, shown), n in counts.items()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
            counts.clear()
            few.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["rule", "example", "violations", "examples"])

        for batch in batches:
            for rule in pc.unique(batch.column(0)).to_pylist():
                part = batch.filter(pc.equal(batch.column(0), rule))
                if rule in apart:
                    for shown, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        counts[rule, shown] = counts.get((rule, shown), 0) + n
                    continue
                counts[rule, None] = counts.get((rule, None), 0) + pc.sum(part.column(2)).as_py()
                least = part.take(pc.sort_indices(part.column(1))[:EXAMPLES])
                shown = [e for e, n in zip(least.column(1).to_pylist(), least.column(2).to_pylist()) for _ in range(min(n, EXAMPLES))]
                few[rule] = sorted([*few.get(rule, []), *shown])[:EXAMPLES]
            if len(counts) > 10_000:
                yield out()
        yield out()

    return entries.select("rule", "example", "n").mapInArrow(run, "rule string, example string, violations bigint, examples array<string>")


def _report_of(parts: DataFrame, severities: Mapping[str, str]) -> DataFrame:
    """One row per rule from parts of the accumulation: at most EXAMPLES strings a task meet."""
    lists = F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, EXAMPLES)
    found = parts.groupBy(F.col("rule").alias("__rule")).agg(F.sum("violations").alias("violations"), lists.alias("examples"))
    named = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity")) for r, s in severities.items()]))
    rules = parts.sparkSession.range(1).select(named)
    none = F.array().cast("array<string>")
    return rules.join(found, F.col("rule") == F.col("__rule"), "left").select(
        "rule", "severity", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("examples", none).alias("examples")
    )


def report(rules: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """One row per rule: severity (``error`` or ``warning``), violations, first examples.

    ``rules`` maps a rule's name to its severity and its frame of violations, each read once.
    """
    entries = [f.select(F.lit(rule).alias("rule"), example(*f.columns).alias("example"), F.lit(1).cast("long").alias("n")) for rule, (_, f) in rules.items()]
    return report_entries(reduce(DataFrame.unionByName, entries), {rule: severity for rule, (severity, _) in rules.items()})


def time_entries(
    df: DataFrame, unique: str, keys: Sequence[str] = (), ts: str = "timestamp", target: str | None = None, known: str = "target_not_null"
) -> DataFrame:
    """What violates the rules ``unique`` (a series has a time once) and ``known`` (the target is not null), from one aggregate."""
    unknown = F.count_if(F.col(target).isNull()) if target else F.lit(0)
    times = df.groupBy(*keys, ts).agg(F.count("*").alias("row_count"), unknown.alias("__unknown"))
    found = [
        _entry(unique, F.col("row_count") > 1, example(*keys, ts, "row_count")),
        _entry(known, F.col("__unknown") > 0, example(*keys, ts), F.col("__unknown")),
    ]
    return times.select(F.inline(F.filter(F.array(*found), lambda e: e.isNotNull())))


def report_entries(entries: DataFrame, severities: Mapping[str, str]) -> DataFrame:
    """The report of rows (rule, example, n) that violate rules."""
    return _report_of(accumulated(entries), severities)


def enforce(findings: DataFrame, name: str = "table") -> None:
    """Raise when an error rule has violations. Collects the report: one row per rule."""
    failed = [r for r in findings.collect() if r["severity"] == "error" and r["violations"] > 0]
    if failed:
        told = "; ".join(f"{r['rule']}: {r['violations']}, e.g. {r['examples']}" for r in failed)
        raise ContractError(f"{name}: {told}")


def series_rules(
    df: DataFrame,
    required: Sequence[str],
    target: str | None = None,
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
    partial_year: int | None = None,
    full_year: int = 8760,
    name: str = "table",
) -> DataFrame:
    """The whole check of a processed table: columns, unique times, no gaps, target, full year.

    All rules read one bucketed frame of the times, in one pass over the table; only rows that violate a
    rule, and a count a bucket for the full year, go on from there.
    """
    require_columns(df, required, name)
    severities = {"unique_timestamp": "error", "continuous": "error"}
    flag = F.col(target).isNull() if target else F.lit(False)
    rows = df.select(*keys, ts, flag.alias("__unknown")).withColumn(AT, to_micros(ts)).withColumn(SEEN, F.col(AT))
    frame = with_edges(rows, [SEEN], keys, step_micros(freq), STEPS_PER_BUCKET, 0)

    ordered, whole = bucket_window(keys), Window.partitionBy(*keys, BUCKET)
    seconds = since_previous(keys) / 1_000_000
    peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    facts = {"__seconds": seconds, "__peers": F.count(F.lit(1)).over(peers), "__place": F.row_number().over(ordered), "__before": F.lag(AT, 1).over(ordered), "__later": ~F.coalesce(F.lag(OWN, 1).over(ordered), F.lit(False))}
    if partial_year is not None:
        facts["__in_year"] = F.count_if(F.col(OWN) & (F.year(ts) == partial_year)).over(whole)
    frame = frame.withColumns(facts).where(OWN)

    off = F.col("__seconds") - F.lit(step_micros(freq) / 1_000_000)
    first = (F.col("__place") == 1) | ~F.col("__before").eqNullSafe(F.col(AT))
    kind = F.when(off > 0, F.lit("gap")).otherwise(F.lit("overlap"))
    entries = [
        _entry("unique_timestamp", first & (F.col("__peers") > 1), example(*keys, ts, F.col("__peers").alias("row_count"))),
        _entry("continuous", F.abs(off) > TOLERANCE_SECONDS, example(*keys, ts, F.col("__seconds").alias("gap_seconds"), kind.alias("kind"))),
    ]
    if target:
        severities["target_not_null"] = "error"
        entries.append(_entry("target_not_null", F.col("__unknown"), example(*keys, ts)))
    if partial_year is not None:
        severities["full_year"] = "warning"
        series = example(*keys) if keys else F.lit("{}")
        entries.append(_entry("full_year", F.col("__later") & (F.col("__in_year") > 0), series, F.col("__in_year")))
    violated = frame.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    parts = accumulated(violated, ["full_year"])
    if partial_year is not None:
        parts = _merged_years(parts, partial_year, full_year)
    return _report_of(parts, severities)


def _entry(rule: str, violated: Column, shown: Column, n: Column | None = None) -> Column:
    n = F.lit(1) if n is None else n
    return F.when(violated, F.struct(F.lit(rule).alias("rule"), shown.alias("example"), n.cast("long").alias("n")))


def _merged_years(parts: DataFrame, year: int, full: int) -> DataFrame:
    """The parts with the rows of each series in the year added up, and those of short years as violations."""
    by_series = F.col("rule") == "full_year"
    met = parts.groupBy("rule", "example").agg(F.sum("violations").alias("violations"), F.flatten(F.collect_list("examples")).alias("examples"))
    head = F.regexp_replace("example", r"\}$", "")
    shown = F.concat(head, F.when(head == "{", "").otherwise(","), F.lit(f'"year":{year},"row_count":'), F.col("violations").cast("string"), F.lit("}"))
    judged = met.where(~by_series | (F.col("violations") < full)).select(
        "rule",
        F.when(by_series, F.lit(1).cast("long")).otherwise(F.col("violations")).alias("violations"),
        F.when(by_series, F.array(shown)).otherwise(F.col("examples")).alias("examples"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        few: dict[str, list[str]] = {}
        for batch in batches:
            for rule, n, examples in zip(*[c.to_pylist() for c in batch.columns]):
                counts[rule] = counts.get(rule, 0) + n
                few[rule] = sorted([*few.get(rule, []), *examples])[:EXAMPLES]
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([few[r] for r in counts], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["rule", "violations", "examples"])

    return judged.mapInArrow(run, "rule string, violations bigint, examples array<string>")

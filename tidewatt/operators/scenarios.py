"""Growth scenarios on a forecast, synthetic baseline years and scenario strain.

A scenario list is configuration: it is written into the plan as literals, and every
forecast row emits one row per scenario, without a join. A scenario *table* of any
size is expanded to (scenario, year) and equi-joined on the year instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.functions.calendar import quarter_label
from tidewatt.functions.timeline import from_micros, step_micros, to_micros
from tidewatt.operators.keyed import SALTS, attach

# The scenarios used when none are given.
DEFAULT_SCENARIOS = [
    {"name": "low", "start_year": 2026, "end_year": 2027, "start_mw": 200.0, "yoy_growth": 0.05},
    {"name": "base", "start_year": 2026, "end_year": 2027, "start_mw": 350.0, "yoy_growth": 0.07},
    {"name": "high", "start_year": 2026, "end_year": 2027, "start_mw": 800.0, "yoy_growth": 0.15},
]
RAMPS = ("flat", "linear_within_year", "step_quarterly")
BASELINE = "baseline"
SCHEMA = "name string, start_year int, end_year int, start_mw double, yoy_growth double"


class ScenarioError(ValueError):
    pass


# --- yearly levels and ramps ----------------------------------------------------


def yearly_levels(scenarios: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """(by, year, mw): ``start_mw`` grown by ``yoy_growth`` for each year of the range."""
    years = F.when(F.col("end_year") >= F.col("start_year"), F.sequence("start_year", "end_year"))
    return scenarios.select("*", F.posexplode(years).alias("__i", "year")).select(
        *by, "year", (F.col("start_mw") * F.pow(1 + F.col("yoy_growth"), F.col("__i"))).alias("mw")
    )


def ramp(shape: str, ts: Column, level: Column, next_level: Column) -> Column:
    """The adder at ``ts`` from the year's level and the next year's (null: stay level)."""
    if shape not in RAMPS:
        raise ScenarioError(f"unknown ramp {shape!r}, expected one of {RAMPS}")
    rise = F.coalesce(next_level, level) - level
    if shape == "flat":
        return level
    if shape == "step_quarterly":
        # the last quarter is the next level itself, not level + rise
        return F.when(F.quarter(ts) == 4, F.coalesce(next_level, level)).otherwise(
            level + rise * ((F.quarter(ts) - 1) / F.lit(3))
        )
    begin = F.make_date(F.year(ts), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    until = F.make_date(F.year(ts) + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    hours = (to_micros(ts) - to_micros(begin)) / F.lit(3_600_000_000)
    span = (to_micros(until) - to_micros(begin)) / F.lit(3_600_000_000) - 1
    return level + rise * (hours / span)


def with_adder(
    df: DataFrame,
    yearly: DataFrame,
    shape: str = "flat",
    ts: str = "timestamp",
    by: Sequence[str] = (),
    allow_missing_years: bool = False,
    name: str = "ai_adder_mw",
) -> DataFrame:
    """Look up each row's year in a table (by, year, mw); a missing year is an error or 0."""
    next_year = Window.partitionBy(*by).orderBy("year")
    following = F.when(F.lead("year").over(next_year) == F.col("year") + 1, F.lead("mw").over(next_year))
    levels = yearly.select(*by, F.col("year").alias("__year"), F.col("mw").alias("__mw"), following.alias("__next"))
    # a year is a large group: its rows are spread over several tasks
    joined = attach(df.withColumn("__year", F.year(ts)), levels, [*by, "__year"], spread_by=[ts])
    value = ramp(shape, F.col(ts), F.col("__mw"), F.col("__next"))
    missing = (
        F.lit(0.0)
        if allow_missing_years
        else F.raise_error(F.concat(F.lit("no scenario level for year "), F.col("__year"))).cast("double")
    )
    adder = F.when(F.col("__mw").isNull(), missing).otherwise(value)
    return joined.select(*df.columns, adder.alias(name))


# --- scenario rows ---------------------------------------------------------------


def check_scenarios(scenarios: Sequence[Mapping], first_year: int, last_year: int) -> list[dict]:
    """Fill in missing years from the forecast's range; reject what cannot be applied."""
    checked = []
    for s in scenarios:
        lacking = [k for k in ("name", "start_mw", "yoy_growth") if s.get(k) is None]
        if lacking:
            raise ScenarioError(f"scenario {s.get('name')!r} lacks {lacking}")
        start = int(first_year if s.get("start_year") is None else s["start_year"])
        end = int(last_year if s.get("end_year") is None else s["end_year"])
        if end < first_year or start > last_year:
            raise ScenarioError(
                f"scenario {s['name']!r} ({start}-{end}) does not overlap the forecast ({first_year}-{last_year})"
            )
        uncovered = [y for y in range(first_year, last_year + 1) if not start <= y <= end]
        if uncovered:
            raise ScenarioError(f"scenario {s['name']!r} has no level for {uncovered}")
        growth = 1.0 + float(s["yoy_growth"])
        if max(float(s["start_mw"]) * growth ** (y - start) for y in range(first_year, last_year + 1)) <= 0:
            raise ScenarioError(f"scenario {s['name']!r} adds nothing")
        checked.append(
            {
                "name": str(s["name"]),
                "start_year": start,
                "end_year": end,
                "start_mw": float(s["start_mw"]),
                "yoy_growth": float(s["yoy_growth"]),
            }
        )
    return checked


def scenario_findings(scenarios: DataFrame, baseline: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The same checks on a scenario table of any size: one row per finding."""
    years = baseline.agg(F.min(F.year(ts)).alias("first"), F.max(F.year(ts)).alias("last"))
    span = years.select(F.struct("first", "last").alias("s")).scalar()
    start = F.coalesce("start_year", F.col("__span.first"))
    end = F.coalesce("end_year", F.col("__span.last"))
    lacking = F.col("name").isNull() | F.col("start_mw").isNull() | F.col("yoy_growth").isNull()
    apart = (end < F.col("__span.first")) | (start > F.col("__span.last"))
    partial = ~apart & ((start > F.col("__span.first")) | (end < F.col("__span.last")))
    rules = [
        ("required key missing", lacking),
        ("no overlap with forecast", apart),
        ("forecast year without level", partial),
        ("adds nothing", F.col("start_mw") <= 0),
    ]
    found = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(t, F.lit(False)).alias("hit")) for r, t in rules])
    return (
        scenarios.withColumn("__span", span)
        .select(F.col("name").alias("scenario"), F.inline(found))
        .where("hit")
        .select("scenario", "rule")
    )


def unknown_ramps(scenarios: DataFrame, ramp: str = "ramp") -> DataFrame:
    """(scenario, rule) of the scenarios whose ramp is none of those that :func:`ramp` knows, or null."""
    known = F.coalesce(F.col(ramp).isin(*RAMPS), F.lit(False))
    return scenarios.where(~known).select(F.col("name").alias("scenario"), F.lit("unknown ramp").alias("rule"))


def forecast_years(forecast: DataFrame, ts: str = "timestamp") -> tuple[int, int]:
    first, last = forecast.agg(F.min(F.year(ts)), F.max(F.year(ts))).first()
    return first, last


def apply_scenarios(
    forecast: DataFrame,
    scenarios: Sequence[Mapping] | DataFrame,
    shape: str = "flat",
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """(keys, ts, scenario, y_hat, ai_adder_mw, y_hat_with_ai), with ``baseline`` rows.

    ``years`` is the forecast's first and last year; without it a small aggregate reads them.
    A row of a year for which a scenario has no level is an error, whatever ``years`` says.
    """
    base = forecast.select(*keys, ts, "y_hat")
    if isinstance(scenarios, DataFrame):
        rows = _joined_rows(base, scenarios, shape, ts, keys)
    else:
        first, last = years or forecast_years(base, ts)
        rows = base.select("*", F.inline(F.array(*_literal_rows(scenarios, shape, ts, first, last))))
    return rows.select(
        *keys, ts, "scenario", "y_hat", "ai_adder_mw", (F.col("y_hat") + F.col("ai_adder_mw")).alias("y_hat_with_ai")
    )


def _literal_rows(scenarios, shape: str, ts: str, first: int, last: int) -> list[Column]:
    rows = [F.struct(F.lit(BASELINE).alias("scenario"), F.lit(0.0).alias("ai_adder_mw"))]
    for s in check_scenarios(scenarios, first, last):
        i = F.year(ts) - F.lit(s["start_year"])
        growth = F.lit(1.0 + s["yoy_growth"])
        level = F.lit(s["start_mw"]) * F.pow(growth, i)
        next_level = F.when(F.year(ts) < s["end_year"], F.lit(s["start_mw"]) * F.pow(growth, i + 1))
        none = F.raise_error(F.concat(F.lit(f"no level of scenario {s['name']} for year "), F.year(ts))).cast("double")
        inside = F.year(ts).between(s["start_year"], s["end_year"])
        adder = F.when(inside, ramp(shape, F.col(ts), level, next_level)).when(F.year(ts).isNotNull(), none)
        rows.append(F.struct(F.lit(s["name"]).alias("scenario"), adder.alias("ai_adder_mw")))
    return rows


def _joined_rows(base: DataFrame, scenarios: DataFrame, shape: str, ts: str, keys: Sequence[str]) -> DataFrame:
    span = base.agg(F.min(F.year(ts)).alias("first"), F.max(F.year(ts)).alias("last"))
    start, end, year = F.col("__start"), F.col("__end"), F.col("__year")
    levels = (
        scenarios.withColumn("__span", span.select(F.struct("first", "last").alias("s")).scalar())
        .withColumns(
            {
                "__start": F.coalesce("start_year", F.col("__span.first")),
                "__end": F.coalesce("end_year", F.col("__span.last")),
                "__year": F.explode(F.sequence(F.col("__span.first"), F.col("__span.last"))),
            }
        )
        .select(
            F.col("name").alias("scenario"),
            "__year",
            F.when(year.between(start, end), _level(year - start)).alias("__mw"),
            F.when((year + 1).between(start, end), _level(year + 1 - start)).alias("__next"),
        )
    )
    unknown = F.raise_error(F.concat(F.lit("no level of "), "scenario", F.lit(" for "), "__year")).cast("double")
    value = ramp(shape, F.col(ts), F.col("__mw"), F.col("__next"))
    adder = F.when(F.col("__mw").isNull(), unknown).otherwise(value)
    # every row meets all scenarios of its year; rows of one year are spread by a salt
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = levels.withColumn("__salt", F.explode(salts))
    spread = base.withColumns(
        {"__year": F.year(ts), "__salt": F.pmod(F.xxhash64(*keys, ts), F.lit(SALTS)).cast("int")}
    )
    added = spread.join(salted, ["__year", "__salt"]).select(
        *base.columns, "scenario", adder.alias("ai_adder_mw")
    )
    untouched = base.select("*", F.lit(BASELINE).alias("scenario"), F.lit(0.0).alias("ai_adder_mw"))
    return untouched.unionByName(added)


def _level(steps: Column) -> Column:
    return F.col("start_mw") * F.pow(1 + F.col("yoy_growth"), steps)


# --- strain of scenarios ----------------------------------------------------------


def scenario_strain(
    rows: DataFrame, threshold: Column, ts: str = "timestamp", keys: Sequence[str] = ()
) -> DataFrame:
    """Peak and high hours per (keys, scenario, year, quarter), with the change against ``y_hat``.

    Every scenario row carries its baseline value, so one aggregate gives both.
    ``threshold`` is the same for all rows of a group.
    """
    grouped = rows.groupBy(*keys, F.year(ts).alias("year"), F.quarter(ts).alias("quarter"), "scenario").agg(
        F.max("y_hat_with_ai").alias("predicted_peak_mw"),
        F.count_if(F.col("y_hat_with_ai") > threshold).alias("predicted_high_hours"),
        F.max(threshold).alias("threshold_used"),
        F.max("y_hat").alias("__peak"),
        F.count_if(F.col("y_hat") > threshold).alias("__high"),
    )
    return grouped.select(
        *keys,
        "year",
        "quarter",
        "scenario",
        "predicted_peak_mw",
        "predicted_high_hours",
        "threshold_used",
        (F.col("predicted_peak_mw") - F.col("__peak")).alias("peak_delta_mw"),
        (F.col("predicted_high_hours") - F.col("__high")).alias("high_hours_delta"),
    )


def against_baseline(strain: DataFrame, baseline: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Deltas of one strain table against another by (keys, year, quarter); absent means 0."""
    on = [*keys, "year", "quarter"]
    base = baseline.select(
        *on, F.col("predicted_peak_mw").alias("__peak"), F.col("predicted_high_hours").alias("__high")
    )
    deltas = {
        "peak_delta_mw": F.col("predicted_peak_mw") - F.coalesce("__peak", F.lit(0.0)),
        "high_hours_delta": F.col("predicted_high_hours") - F.coalesce("__high", F.lit(0)),
    }
    return strain.join(base, on, "left").withColumns(deltas).drop("__peak", "__high")


def baseline_strain(strain: DataFrame) -> DataFrame:
    return strain.where(F.col("scenario") == BASELINE)


def season_summary(strain: DataFrame, quarters: Sequence[int] = (1, 3)) -> DataFrame:
    """First and third quarter with signed changes; ``place`` puts the baseline first."""
    return strain.where(F.col("quarter").isin(*quarters)).withColumns(
        {
            "place": F.when(F.col("scenario") == BASELINE, 0).otherwise(1),
            "quarter_label": quarter_label(F.col("year"), F.col("quarter")),
            "peak_change": _signed("peak_delta_mw"),
            "high_hours_change": _signed("high_hours_delta"),
        }
    )


def _signed(c: str) -> Column:
    whole = F.round(F.col(c), 0).cast("bigint")
    return F.when(F.col("scenario") == BASELINE, F.lit("")).otherwise(
        F.concat(F.when(F.col(c) >= 0, "+").otherwise(""), whole.cast("string"))
    )


# --- synthetic baseline -------------------------------------------------------------


def synthetic_year(
    template: DataFrame,
    year: int,
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    freq: str = "1 hour",
) -> DataFrame:
    """A forecast for ``year`` that repeats the template's value of the same date and hour.

    Feb 29 takes Feb 28 when the template's (first) year has none. A step the template
    lacks takes the series' mean for that hour of day, else 0. A template row whose value
    is null stays null.
    """
    step = step_micros(freq)
    hours = [F.avg(F.when(F.hour(ts) == h, F.col("y_hat"))) for h in range(24)]
    series = template.groupBy(*keys).agg(F.min(F.year(ts)).alias("__ty"), F.array(*hours).alias("__hour_means"))
    begin = F.make_date(F.lit(year), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    until = F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    # day by day, then the steps of a day: no array holds more than a year of days
    days = F.sequence(to_micros(begin), to_micros(until) - 1, F.lit(max(step, 86_400_000_000)))
    calendar = series.where(F.col("__ty").isNotNull()).select("*", F.explode(days).alias("__day"))
    if step < 86_400_000_000:
        inside = F.sequence(F.col("__day"), F.col("__day") + F.lit(86_400_000_000 - 1), F.lit(step))
        calendar = calendar.select("*", F.explode(inside).alias("__at"))
    else:
        calendar = calendar.withColumn("__at", F.col("__day"))
    calendar = calendar.withColumn(ts, from_micros("__at"))
    at = F.col(ts)

    def same(day):
        return F.try_make_timestamp_ntz(
            F.col("__ty"), F.month(at), day, F.hour(at), F.minute(at), F.second(at).cast("decimal(8,6)")
        )

    wanted = calendar.withColumn("__source", F.coalesce(same(F.dayofmonth(at)), same(F.lit(28))))
    # of template rows with the same time, the smallest value: rows have no order to take a first of
    known = template.groupBy(*keys, F.col(ts).alias("__source")).agg(F.min("y_hat").alias("y_hat"), F.lit(True).alias("__matched"))
    fallback = F.coalesce(F.get(F.col("__hour_means"), F.hour(at)), F.lit(0.0))
    value = F.when(F.col("__matched"), F.col("y_hat")).otherwise(fallback)
    return wanted.join(known, [*keys, "__source"], "left").select(
        *keys, ts, value.alias("y_hat"), F.lit(True).alias("baseline_is_synthetic")
    )

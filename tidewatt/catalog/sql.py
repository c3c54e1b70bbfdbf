"""SQL building blocks for the equivalent DuckDB queries."""

from __future__ import annotations

from collections.abc import Sequence

HOURLY = """hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS timestamp, round(sum(value), 2) AS y
  FROM events GROUP BY 1, 2)"""

DAILY = """daily AS (
  SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS timestamp, round(sum(o_totalprice), 2) AS y
  FROM orders GROUP BY 1)"""

NATION_DAILY = """nation_daily AS (
  SELECT c_nationkey, date_trunc('day', o_orderdate)::TIMESTAMP AS timestamp, round(sum(o_totalprice), 2) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

DEMAND_RAW = """demand_raw AS (
  SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS timestamp,
         round(sum(o_totalprice), 2) AS ontario_demand_mw,
         round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS market_demand_mw
  FROM orders GROUP BY 1)"""

WEATHER = """weather AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp,
         round(avg(l_quantity), 4) AS temp_c,
         round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS dewpoint_c,
         round(avg(l_linenumber), 4) AS rel_hum_pct,
         sum(CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN l_quantity END) AS precip_mm,
         count(CASE WHEN l_returnflag = 'R' THEN 1 END) = 0 AS is_imputed_weather
  FROM lineitem GROUP BY 1)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _list(keys: Sequence[str], prefix: str = "") -> str:
    return "".join(f"{prefix}{k}, " for k in keys)


def _partition(keys: Sequence[str]) -> str:
    return "PARTITION BY " + ", ".join(keys) if keys else ""


def on_grid(source: str, out: str, columns: Sequence[str], keys: Sequence[str] = (), unit: str = "HOUR") -> str:
    """``out``: every step of ``source`` from first to last, with ``is_new``."""
    using = ", ".join([*keys, "timestamp"])
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""{out}_steps AS (
  SELECT {_list(keys)}unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 {unit})) AS timestamp
  FROM {source} {group}),
{out} AS (
  SELECT {_list(keys, 'g.')}g.timestamp, {', '.join(f's.{c}' for c in columns)}, s.timestamp IS NULL AS is_new
  FROM {out}_steps g LEFT JOIN {source} s USING ({using}))"""


def filled(source: str, out: str, columns: Sequence[str], keys: Sequence[str] = (), how: str = "filled") -> str:
    """``out``: ``source`` with each column c and its fill c_<how>: interpolated, forward, backward, filled."""
    near = []
    for c in columns:
        near += [
            f"last_value(CASE WHEN {c} IS NOT NULL THEN timestamp END IGNORE NULLS) OVER b AS {c}_pt",
            f"last_value({c} IGNORE NULLS) OVER b AS {c}_pv",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN timestamp END IGNORE NULLS) OVER f AS {c}_nt",
            f"first_value({c} IGNORE NULLS) OVER f AS {c}_nv",
        ]
    part = _partition(keys)

    def expression(c: str) -> str:
        if how == "forward":
            return f"{c}_pv"
        if how == "backward":
            return f"{c}_nv"
        leading = "NULL" if how == "interpolated" else f"{c}_nv"
        share = f"((epoch_us(timestamp) - epoch_us({c}_pt))::DOUBLE / (epoch_us({c}_nt) - epoch_us({c}_pt))::DOUBLE)"
        return (
            f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pv IS NULL THEN {leading} "
            f"WHEN {c}_nv IS NULL THEN {c}_pv ELSE {c}_pv + ({c}_nv - {c}_pv) * {share} END"
        )

    fills = ", ".join(f"{expression(c)} AS {c}_{how}" for c in columns)
    return f"""{out}_near AS (
  SELECT *, {', '.join(near)} FROM {source}
  WINDOW b AS ({part} ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS ({part} ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT *, {fills} FROM {out}_near)"""


HOURLY_GRID = on_grid("hourly", "hourly_grid", ["y"], ["event_type"])
HOURLY_FILLED = f"""{HOURLY},
{HOURLY_GRID},
{filled('hourly_grid', 'hourly_known', ['y'], ['event_type'])},
hourly_filled AS (
  SELECT event_type, timestamp, y_filled AS y, is_new OR y IS NULL AS is_imputed FROM hourly_known)"""

DAILY_FILLED = f"""{DAILY},
{on_grid('daily', 'daily_grid', ['y'], unit='DAY')},
{filled('daily_grid', 'daily_known', ['y'])},
daily_filled AS (SELECT timestamp, y_filled AS y, is_new AS is_imputed FROM daily_known)"""

NATION_FILLED = f"""{NATION_DAILY},
{on_grid('nation_daily', 'nation_grid', ['y'], ['c_nationkey'], unit='DAY')},
{filled('nation_grid', 'nation_known', ['y'], ['c_nationkey'])},
nation_filled AS (SELECT c_nationkey, timestamp, y_filled AS y, is_new AS is_imputed FROM nation_known)"""

DEMAND = f"""{DEMAND_RAW},
{on_grid('demand_raw', 'demand_grid', ['ontario_demand_mw', 'market_demand_mw'], unit='DAY')},
{filled('demand_grid', 'demand_known', ['ontario_demand_mw', 'market_demand_mw'])},
demand AS (
  SELECT timestamp, ontario_demand_mw_filled AS ontario_demand_mw, market_demand_mw_filled AS market_demand_mw,
         CASE WHEN is_new THEN 'IMPUTED' ELSE 'orders' END AS source_file,
         is_new OR ontario_demand_mw IS NULL OR market_demand_mw IS NULL AS is_imputed
  FROM demand_known)"""

DAILY_FORECAST = f"""{DAILY_FILLED},
forecast AS (
  SELECT * FROM (SELECT timestamp, y, lag(y, 7) OVER (ORDER BY timestamp) AS y_hat FROM daily_filled)
  WHERE y_hat IS NOT NULL)"""

HOURLY_FORECAST = f"""{HOURLY_FILLED},
hourly_forecast AS (
  SELECT * FROM (SELECT event_type, timestamp, y,
                        lag(y, 24) OVER (PARTITION BY event_type ORDER BY timestamp) AS y_hat FROM hourly_filled)
  WHERE y_hat IS NOT NULL)"""

SEGMENTS = """segments AS (
  SELECT c_mktsegment AS name, 1995::INTEGER AS start_year, 2001::INTEGER AS end_year,
         round(avg(abs(c_acctbal)) * 10, 2) AS start_mw,
         round(count(CASE WHEN c_acctbal > 0 THEN 1 END)::DOUBLE / count(*) / 10, 4) AS yoy_growth
  FROM customer GROUP BY 1)"""

_CALENDAR = """hour(timestamp)::INTEGER AS hour, (isodow(timestamp) - 1)::INTEGER AS day_of_week,
  month(timestamp)::INTEGER AS month, year(timestamp)::INTEGER AS year, quarter(timestamp)::INTEGER AS quarter,
  isodow(timestamp) IN (6, 7) AS is_weekend,
  sin(2 * pi() * hour(timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24) AS hour_cos,
  sin(2 * pi() * dayofyear(timestamp) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(timestamp) / 365.25) AS doy_cos"""


def split_case(train_end: str, val_end: str, ts: str = "timestamp") -> str:
    return (
        f"CASE WHEN {ts} <= TIMESTAMP '{train_end}' THEN 'train' "
        f"WHEN {ts} <= TIMESTAMP '{val_end}' THEN 'val' ELSE 'test' END"
    )


def dataset(demand: str, out: str, target: str, keys: Sequence[str] = (), extra: Sequence[str] = ()) -> str:
    """``out``: the daily model dataset on the spine ``demand``, unrounded."""
    part = _partition(keys)
    w = f"({part} ORDER BY timestamp ROWS BETWEEN"
    fill = filled(f"{out}_joined", f"{out}_wx", ["temp_c", "dewpoint_c", "rel_hum_pct"], keys)
    passed = "".join(f"{c}, " for c in extra)
    return f"""{out}_joined AS (
  SELECT d.*, w.temp_c, w.dewpoint_c, w.rel_hum_pct, coalesce(w.precip_mm, 0.0) AS precip_mm,
         w.temp_c IS NULL OR coalesce(w.is_imputed_weather, false) AS weather_was_missing
  FROM {demand} d LEFT JOIN weather w USING (timestamp)),
{fill},
{out} AS (
  SELECT {_list(keys)}timestamp, {target} AS y, {passed}temp_c_filled AS temp_c, dewpoint_c_filled AS dewpoint_c,
         rel_hum_pct_filled AS rel_hum_pct, precip_mm,
         CASE WHEN temp_c_filled IS NOT NULL THEN greatest(0.0, 25.5 - temp_c_filled) END AS hdd_18,
         CASE WHEN temp_c_filled IS NOT NULL THEN greatest(0.0, temp_c_filled - 25.5) END AS cdd_18,
         {_CALENDAR},
         lag({target}, 1) OVER o AS demand_lag_1d, lag({target}, 7) OVER o AS demand_lag_7d,
         lag({target}, 28) OVER o AS demand_lag_28d,
         avg({target}) OVER {w} 7 PRECEDING AND 1 PRECEDING) AS demand_rollmean_7d,
         avg({target}) OVER {w} 28 PRECEDING AND 1 PRECEDING) AS demand_rollmean_28d,
         is_imputed, weather_was_missing,
         {split_case('1999-12-31 00:00:00', '2000-12-31 00:00:00')} AS split
  FROM {out}_wx WINDOW o AS ({part} ORDER BY timestamp))"""


DATASET = f"""{DEMAND},
{WEATHER},
{dataset('demand', 'dataset', 'ontario_demand_mw', extra=['market_demand_mw'])}"""

NATION_DATASET = f"""{NATION_FILLED},
{WEATHER},
{dataset('nation_filled', 'dataset', 'y', ['c_nationkey'])}"""


def leaning(exact: Sequence[str], doubles: Sequence[str], decimals: int) -> str:
    """Columns with the doubles rounded so that ties go up in spite of the last bits."""
    return ", ".join([*exact, *[f"floor({c} * 1e{decimals} + 0.501) / 1e{decimals} AS {c}" for c in doubles]])


LEAN = 1e-4


def lean(expression: str, decimals: int) -> str:
    """Rounded as ``rounded(..., lean=LEAN)`` does: a tie goes up even where the last bits of a sum fall short of it."""
    return f"floor(({expression}) * 1e{decimals} + {0.5 + LEAN}) / 1e{decimals}"


DATASET_EXACT = [
    "timestamp", "hour", "day_of_week", "month", "year", "quarter", "is_weekend", "is_imputed",
    "weather_was_missing", "split",
]
DATASET_DOUBLES = [
    "y", "temp_c", "dewpoint_c", "rel_hum_pct", "precip_mm", "hdd_18", "cdd_18", "hour_sin", "hour_cos",
    "doy_sin", "doy_cos", "demand_lag_1d", "demand_lag_7d", "demand_lag_28d", "demand_rollmean_7d",
    "demand_rollmean_28d",
]

"""Column expressions, filters and projections."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.inputs import (
    DAY_BASE,
    HOUR_TRAIN_END,
    HOUR_VAL_END,
    daily,
    daily_dataset,
    daily_weather,
    hourly,
    table,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.functions import calendar, cleaning
from tidewatt.functions.timeline import ntz, plus_days
from tidewatt.operators import metrics
from tidewatt.plans.features import dry_where_unknown


@query(
    "p1_hour_ending_timestamp",
    """SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS timestamp FROM events""",
)
def hour_ending(spark, sf):
    labelled = table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("date").alias("Date"), (F.hour("ts") + 1).alias("Hour")
    )
    return labelled.select("event_id", calendar.hour_ending(F.col("Date"), F.col("Hour")).alias("timestamp"))


_MIXED_TEXT = """CASE event_type WHEN 'view' THEN 'M' WHEN 'click' THEN ' ' || props
  WHEN 'error' THEN '' ELSE ' ' || event_id || ' ' END"""


def mixed_text():
    kind = F.col("event_type")
    return (
        F.when(kind == "view", F.lit("M"))
        .when(kind == "click", F.concat(F.lit(" "), "props"))
        .when(kind == "error", F.lit(""))
        .otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
    )


@query("p2_plain_number", f"SELECT event_id, TRY_CAST(trim({_MIXED_TEXT}) AS DOUBLE) AS number FROM events")
def plain_number(spark, sf):
    return table(spark, sf, "events").select("event_id", cleaning.plain_number(mixed_text()).alias("number"))


def _dirty_sql(text: str) -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
    gone = "chr(8722) || ',' || chr(160) || chr(8203) || chr(65533)"
    bare = f"translate(trim(trim(trim({text}, {blanks}), '\"'), ''''), {gone}, '-.')"
    return (
        f"CASE WHEN {bare} NOT IN ('', 'NA', 'N/A', 'nan', 'None') "
        f"THEN TRY_CAST(regexp_extract({bare}, '([-+]?\\d*\\.?\\d+)', 1) AS DOUBLE) END"
    )


@query("p3_dirty_number_in_text", f"SELECT doc_id, {_dirty_sql('text')} AS number FROM documents")
def dirty_number_in_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.dirty_number(F.col("text")).alias("number"))


@query(
    "p3_dirty_number_in_props",
    f"""SELECT event_id, {_dirty_sql("' ' || chr(8722) || replace(value::VARCHAR, '.', ',') || '* ' || props")}
        AS number FROM events""",
)
def dirty_number_in_props(spark, sf):
    value = F.concat(
        F.lit(" −"), F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit("* "), "props"
    )
    return table(spark, sf, "events").select("event_id", cleaning.dirty_number(value).alias("number"))


@query(
    "p4_readable_time",
    """SELECT event_id, date_trunc('minute', ts)::TIMESTAMP AS timestamp FROM events WHERE event_type <> 'error'""",
)
def readable_time(spark, sf):
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.substring(F.col("ts").cast("string"), 1, 16)
    )
    rows = table(spark, sf, "events").select("event_id", cleaning.readable_time(text).alias("timestamp"))
    return rows.where(F.col("timestamp").isNotNull())


@query(
    "p6_degree_days",
    sql.ctes(sql.WEATHER)
    + f"""SELECT timestamp, dewpoint_c,
      CASE WHEN dewpoint_c IS NOT NULL THEN round(greatest(0.0, {DAY_BASE} - dewpoint_c), 6) + 0.0 END AS hdd_18,
      CASE WHEN dewpoint_c IS NOT NULL THEN round(greatest(0.0, dewpoint_c - {DAY_BASE}), 6) + 0.0 END AS cdd_18
    FROM weather""",
)
def degree_days(spark, sf):
    rows = daily_weather(spark, sf).select("timestamp", "dewpoint_c")
    return rounded(calendar.with_degree_days(rows, "dewpoint_c", DAY_BASE))


@query(
    "p7_p8_p9_calendar",
    """SELECT event_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week,
      month(ts)::INTEGER AS month, year(ts)::INTEGER AS year, quarter(ts)::INTEGER AS quarter,
      isodow(ts) IN (6, 7) AS is_weekend,
      round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin,
      round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos,
      round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) + 0.0 AS doy_sin,
      round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) + 0.0 AS doy_cos FROM events""",
)
def calendar_features(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return rounded(calendar.with_calendar(rows, "ts").drop("ts"))


@query(
    "p7_p8_calendar_of_orders",
    """SELECT o_orderkey, (isodow(o_orderdate) - 1)::INTEGER AS day_of_week, month(o_orderdate)::INTEGER AS month,
      year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter,
      isodow(o_orderdate) IN (6, 7) AS is_weekend,
      round(sin(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) + 0.0 AS doy_sin,
      round(cos(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) + 0.0 AS doy_cos FROM orders""",
)
def calendar_of_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rounded(calendar.with_calendar(rows, "o_orderdate").drop("o_orderdate", "hour", "hour_sin", "hour_cos"))


@query(
    "p10_trend",
    f"""SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2019-01-01 00:00:00'))::DOUBLE
      / (365.25 * 86400 * 1000000), 9) AS years_since_2019 FROM events""",
)
def trend(spark, sf):
    value = calendar.years_since(F.col("ts"))
    return rounded(table(spark, sf, "events").select("event_id", value.alias("years_since_2019")), 9)


@query(
    "p11_split_label",
    sql.ctes(sql.HOURLY)
    + f"SELECT event_type, timestamp, {sql.split_case(HOUR_TRAIN_END, HOUR_VAL_END)} AS split FROM hourly",
)
def split_label(spark, sf):
    label = calendar.split_label(F.col("timestamp"), HOUR_TRAIN_END, HOUR_VAL_END)
    return hourly(spark, sf).select("event_type", "timestamp", label.alias("split"))


@query(
    "p12_model_dataset",
    sql.ctes(sql.DATASET)
    + f"SELECT {sql.leaning(sql.DATASET_EXACT, [*sql.DATASET_DOUBLES, 'market_demand_mw'], 4)} FROM dataset",
)
def whole_dataset(spark, sf):
    return rounded(daily_dataset(spark, sf), 4, lean=1e-3)


@query(
    "p13_above_threshold",
    sql.ctes(sql.HOURLY)
    + """SELECT event_type, count(CASE WHEN y > 150.0 THEN 1 END) AS high_hours FROM hourly GROUP BY 1""",
)
def above_threshold(spark, sf):
    return hourly(spark, sf).groupBy("event_type").agg(F.count_if(F.col("y") > F.lit(150.0)).alias("high_hours"))


@query(
    "p14_dry_where_unknown",
    sql.ctes(sql.WEATHER) + "SELECT timestamp, coalesce(precip_mm, 0.0) AS precip_mm FROM weather",
)
def no_precipitation(spark, sf):
    return dry_where_unknown(daily_weather(spark, sf).select("timestamp", "precip_mm"))


@query(
    "p15_split_filter",
    sql.ctes(sql.DATASET) + "SELECT timestamp, round(y, 6) AS y FROM dataset WHERE split = 'val'",
)
def split_filter(spark, sf):
    return rounded(daily_dataset(spark, sf).where(F.col("split") == "val").select("timestamp", "y"))


_CASES = [c for c in sql.DATASET_DOUBLES if c != "y"]


@query(
    "p16_complete_cases",
    sql.ctes(sql.DATASET)
    + f"""SELECT timestamp, round(y, 6) AS y, round(demand_lag_28d, 6) AS demand_lag_28d FROM dataset
      WHERE y IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _CASES)}""",
)
def complete_cases(spark, sf):
    dataset = daily_dataset(spark, sf)
    kept = metrics.complete_cases(dataset, metrics.feature_columns(dataset))
    return rounded(kept.select("timestamp", "y", "demand_lag_28d"))


_FEATURES = sorted(
    [*_CASES, "market_demand_mw", "hour", "day_of_week", "month", "year", "quarter", "is_weekend"]
)


@query(
    "p17_feature_means",
    sql.ctes(sql.DATASET)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}::DOUBLE), 6) + 0.0 AS mean FROM dataset"
        if c != "is_weekend"
        else f"SELECT '{c}' AS feature, round(avg({c}::INTEGER::DOUBLE), 6) + 0.0 AS mean FROM dataset"
        for c in _FEATURES
    ),
)
def feature_means(spark, sf):
    dataset = daily_dataset(spark, sf)
    return rounded(metrics.feature_scale(dataset, metrics.feature_columns(dataset)).select("feature", "mean"))


@query(
    "p18_quarter_label",
    """SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter_label, count(*) AS order_count
       FROM orders GROUP BY 1""",
)
def quarter_label(spark, sf):
    label = calendar.quarter_label(F.year("o_orderdate"), F.quarter("o_orderdate"))
    return table(spark, sf, "orders").groupBy(label.alias("quarter_label")).agg(F.count("*").alias("order_count"))


@query(
    "p19_time_range",
    sql.ctes(sql.DAILY)
    + """SELECT timestamp, y FROM daily WHERE timestamp BETWEEN TIMESTAMP '2000-02-29' - INTERVAL 7 DAY
      AND TIMESTAMP '2000-02-29' + INTERVAL 7 DAY""",
)
def time_range(spark, sf):
    middle = ntz("2000-02-29 00:00:00")
    return daily(spark, sf).where(F.col("timestamp").between(plus_days(middle, -7), plus_days(middle, 7)))

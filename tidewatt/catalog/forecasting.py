"""Models, back-test tables and the union of metrics."""

from pyspark.sql import functions as F

from tidewatt.catalog import sql
from tidewatt.catalog.inputs import (
    DAY_LAGS,
    DAY_MEANS,
    DAY_ORIGIN,
    daily_dataset,
    hourly_filled,
    written_dataset,
    written_dataset_by_nation,
)
from tidewatt.catalog.registry import query, rounded
from tidewatt.functions.calendar import DAYS_PER_YEAR
from tidewatt.models import LagRidge, LinearWeatherRidge, PooledMLP, SeasonalNaive
from tidewatt.models import mlp, ridge
from tidewatt.operators import metrics, windows
from tidewatt.operators.quantile import exact_percentile
from tidewatt.plans import backtest, reports

# Two lags keep the closed form short enough to be written in SQL.
TWO_LAGS = ["demand_lag_1d", "demand_lag_7d"]
_DAY_FEATURES = [*DAY_LAGS, *DAY_MEANS]


def naive():
    return SeasonalNaive("demand_lag_7d", "SeasonalNaive7")


def lag_ridge(features=TWO_LAGS):
    return LagRidge(features=features)


def weather_ridge():
    return LinearWeatherRidge(trend_origin=DAY_ORIGIN)


@query(
    "m1_seasonal_naive",
    sql.ctes(sql.HOURLY_FILLED)
    + """SELECT event_type, timestamp, round(y, 6) AS y,
         round(lag(y, 168) OVER (PARTITION BY event_type ORDER BY timestamp), 6) AS y_hat FROM hourly_filled""",
)
def seasonal_naive(spark, sf):
    series = hourly_filled(spark, sf).select("event_type", "timestamp", "y")
    lagged = windows.with_lags_and_means(series, "y", {"demand_lag_168h": 168}, {}, keys=["event_type"])
    return rounded(SeasonalNaive().transform(lagged).drop("demand_lag_168h"))


def _gram_sql(features, source: str = "train") -> str:
    """Means, variances and covariances with the target, one row per feature."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*features, "y"])
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS feature, count(*) AS n_samples, round(avg({a}), 3) + 0.0 AS mean,
            round(covar_pop({a}, y) / stddev_pop(y) / stddev_pop({a}), 6) + 0.0 AS corr_y FROM {source} WHERE {known}"""
        for a in features
    )


def _gram(train, features):
    cross = ridge.cross_products(train, features)
    k = len(features)
    squares = [sum(k + 1 - r for r in range(i)) for i in range(k)]  # position of (i, i)
    y_square = metrics.complete_cases(train, features).agg(
        (F.var_pop("y") * F.count("*")).alias("v")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.get("means", F.lit(i)).alias("mean"),
                F.get("products", F.lit(squares[i] + k - i)).alias("with_y"),
                F.get("products", F.lit(squares[i])).alias("square"),
            )
            for i, name in enumerate(features)
        ]
    )
    out = cross.select("n_samples", F.inline(rows)).withColumn("y_square", y_square.scalar())
    corr = F.col("with_y") / F.sqrt(F.col("square") * F.col("y_square"))
    return out.select("feature", "n_samples", "mean", corr.alias("corr_y"))


_WEATHER_INPUTS = [*ridge.WEATHER_FEATURES[:2], *ridge.WEATHER_FEATURES[4:6]]
_TRAIN = "train AS (SELECT * FROM dataset WHERE split = 'train')"


def _split(spark, sf, split="train"):
    return daily_dataset(spark, sf).where(F.col("split") == split)


@query("m2_weather_cross_products", sql.ctes(sql.DATASET, _TRAIN) + _gram_sql(_WEATHER_INPUTS))
def weather_cross_products(spark, sf):
    """Hour terms are constant on daily data and left out, as their correlation is undefined."""
    found = _gram(_split(spark, sf), _WEATHER_INPUTS)
    return found.select(
        "feature",
        "n_samples",
        (F.floor(F.col("mean") * 1000 + 0.5) / 1000).alias("mean"),
        (F.floor(F.col("corr_y") * 1e6 + 0.5) / 1e6).alias("corr_y"),
    )


@query("m3_lag_cross_products", sql.ctes(sql.DATASET, _TRAIN) + _gram_sql(_DAY_FEATURES))
def lag_cross_products(spark, sf):
    found = _gram(_split(spark, sf), _DAY_FEATURES)
    return found.select(
        "feature",
        "n_samples",
        (F.floor(F.col("mean") * 1000 + 0.5) / 1000).alias("mean"),
        (F.floor(F.col("corr_y") * 1e6 + 0.5) / 1e6).alias("corr_y"),
    )


def _two_lag_fit(keys: str = "") -> str:
    """Ridge with two inputs in closed form; alpha = 1."""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""sums AS (SELECT {keys}count(*) AS n, avg(demand_lag_1d) AS m1, avg(demand_lag_7d) AS m7, avg(y) AS my,
    var_pop(demand_lag_1d) * count(*) + 1 AS s11, var_pop(demand_lag_7d) * count(*) + 1 AS s77,
    covar_pop(demand_lag_1d, demand_lag_7d) * count(*) AS s17,
    covar_pop(demand_lag_1d, y) * count(*) AS s1y, covar_pop(demand_lag_7d, y) * count(*) AS s7y
  FROM dataset WHERE split = 'train' AND demand_lag_1d IS NOT NULL AND demand_lag_7d IS NOT NULL AND y IS NOT NULL
  {group}),
coefs AS (SELECT *, (s1y * s77 - s7y * s17) / (s11 * s77 - s17 * s17) AS b1,
    (s7y * s11 - s1y * s17) / (s11 * s77 - s17 * s17) AS b7 FROM sums),
fit AS (SELECT *, my - b1 * m1 - b7 * m7 AS b0 FROM coefs)"""


@query(
    "m3_m4_m5_lag_ridge_fit",
    sql.ctes(sql.DATASET, _two_lag_fit())
    + """SELECT 'intercept' AS feature, round(b0, 3) AS coef, n AS n_samples FROM fit
      UNION ALL SELECT 'demand_lag_1d', round(b1, 3) + 0.0, n FROM fit
      UNION ALL SELECT 'demand_lag_7d', round(b7, 3) + 0.0, n FROM fit""",
)
def lag_ridge_fit(spark, sf):
    model, train = lag_ridge(), _split(spark, sf)
    params = model.fit(train)
    samples = params.select("n_samples")
    return rounded(model.coefficients(train, params).withColumn("n_samples", samples.scalar()), 3)


@query(
    "m5_lag_ridge_fit_by_nation",
    sql.ctes(sql.NATION_DATASET, _two_lag_fit("c_nationkey, "))
    + "SELECT c_nationkey, n AS n_samples, round(b0, 2) AS intercept, round(b1, 4) + 0.0 AS b1, round(b7, 4) + 0.0 AS b7 FROM fit",
)
def lag_ridge_fit_by_nation(spark, sf):
    train = written_dataset_by_nation(spark, sf).where(F.col("split") == "train")
    params = lag_ridge().fit(train, ["c_nationkey"])

    def at(c, decimals):
        return F.floor(c * 10**decimals + 0.5) / 10**decimals

    return params.select(
        "c_nationkey",
        "n_samples",
        at(F.col("intercept"), 2).alias("intercept"),
        at(F.get("coefs", F.lit(0)), 4).alias("b1"),
        at(F.get("coefs", F.lit(1)), 4).alias("b7"),
    )


_SCORED = """scored AS (SELECT d.timestamp, d.split, d.y, b0 + b1 * demand_lag_1d + b7 * demand_lag_7d AS y_hat
  FROM dataset d, fit WHERE split <> 'train')"""


@query(
    "m6_linear_scoring",
    sql.ctes(sql.DATASET, _two_lag_fit(), _SCORED)
    + "SELECT timestamp, split, round(y, 3) AS y, round(y_hat, 2) AS y_hat FROM scored",
)
def linear_scoring(spark, sf):
    dataset, model = written_dataset(spark, sf), lag_ridge()
    params = model.fit(dataset.where(F.col("split") == "train"))
    scored = model.transform(dataset.where(F.col("split") != "train"), params)
    return rounded(scored.select("timestamp", "split", "y"), 3).join(
        rounded(scored.select("timestamp", "y_hat"), 2), "timestamp"
    )


@query("m2_weather_ridge_scores")
def weather_ridge_scores(spark, sf):
    dataset, model = written_dataset(spark, sf), weather_ridge()
    params = model.fit(dataset.where(F.col("split") == "train"))
    scored = model.transform(dataset.where(F.col("split") != "train"), params)
    return scored.select("timestamp", "split", "y", "y_hat")


@query(
    "m2_weather_ridge_normal_equations",
    sql.ctes(sql.DATASET)
    + """SELECT unnest(['hdd_18', 'cdd_18', 'hour_sin', 'hour_cos', 'doy_sin', 'doy_cos', 'is_weekend', 'years_since_2019'])
           AS feature, count(*) AS n_samples, round(avg(y), 3) AS mean_y, 0.0::DOUBLE AS gap
         FROM dataset WHERE split = 'train' AND y IS NOT NULL AND hdd_18 IS NOT NULL""",
)
def weather_ridge_normal_equations(spark, sf):
    """What defines the fit: for each of the eight inputs, centred, its product with the errors is
    alpha times its coefficient. ``gap`` is the difference, relative to the input's and the target's spread."""
    train, model = written_dataset(spark, sf).where(F.col("split") == "train"), weather_ridge()
    rows, features = model.inputs(train)
    params = model.fit(train)
    errors = model.transform(train, params).select("timestamp", (F.col("y") - F.col("y_hat")).alias("error"))
    known = metrics.complete_cases(rows, features).join(errors, "timestamp")
    coefs = params.select("coefs").scalar()
    facts = []
    for i, name in enumerate(features):
        x = F.col(name).cast("double")
        product = F.covar_pop(x, F.col("error")) * F.count("*") - model.alpha * F.get(F.max("coefs"), F.lit(i))
        spread = F.count("*") * F.greatest(F.stddev_pop(x), F.lit(1.0)) * F.stddev_pop("y")
        gap = F.floor(F.abs(product / spread) * 1e6 + 0.5) / 1e6
        facts.append(F.struct(F.lit(name).alias("feature"), gap.alias("gap")))
    found = known.withColumn("coefs", coefs).agg(F.count("*").alias("n_samples"), F.avg("y").alias("mean_y"), F.array(*facts).alias("facts"))
    mean = F.floor(F.col("mean_y") * 1000 + 0.5) / 1000
    return found.select("n_samples", mean.alias("mean_y"), F.inline("facts")).select("feature", "n_samples", "mean_y", "gap")


def small_mlp(**changes):
    """Limit of rounds, patience and layers as by default."""
    return PooledMLP(**{"partitions": 4, "exclude": ["market_demand_mw"], **changes})


@query("m7_mlp_training")
def mlp_training(spark, sf):
    train = written_dataset(spark, sf).where(F.col("split") == "train")
    return small_mlp().fit(train)


# Fixed weights of a network with two inputs and two hidden units, scaling included.
_FIXED = {
    "flat": [0.5, -0.25, 0.25, 0.75, 0.1, -0.2, 0.6, 0.4, 0.05],
    "means": [100.0, 120.0, 110.0],
    "spreads": [50.0, 40.0, 45.0],
}


@query(
    "m8_mlp_scoring_fixed_weights",
    sql.ctes(sql.HOURLY_FILLED)
    + """SELECT event_type, timestamp, floor(((greatest(0.0, 0.5 * a + 0.25 * b + 0.1) * 0.6
           + greatest(0.0, -0.25 * a + 0.75 * b - 0.2) * 0.4 + 0.05) * 45 + 110) * 1e6 + 0.5001) / 1e6 AS y_hat
      FROM (SELECT event_type, timestamp, (l1 - 100) / 50 AS a, (l24 - 120) / 40 AS b FROM (
        SELECT event_type, timestamp, lag(y, 1) OVER o AS l1, lag(y, 24) OVER o AS l24 FROM hourly_filled
        WINDOW o AS (PARTITION BY event_type ORDER BY timestamp)))
      WHERE a IS NOT NULL AND b IS NOT NULL
      UNION ALL SELECT event_type, timestamp, NULL FROM (
        SELECT event_type, timestamp, row_number() OVER (PARTITION BY event_type ORDER BY timestamp) AS r
        FROM hourly_filled) WHERE r <= 24""",
)
def mlp_scoring(spark, sf):
    series = hourly_filled(spark, sf).select("event_type", "timestamp", "y")
    lagged = windows.with_lags_and_means(series, "y", {"l1": 1, "l24": 24}, {}, keys=["event_type"])
    layout = mlp.Layout((2, 2, 1))
    scored = mlp.score(lagged, layout, _FIXED["flat"], ["l1", "l24"], _FIXED["means"], _FIXED["spreads"])
    return rounded(scored.select("event_type", "timestamp", "y_hat"), lean=1e-4)


@query(
    "m7_full_batch_step",
    sql.ctes(sql.HOURLY_FILLED)
    + """, inputs AS (SELECT (l1 - 100) / 50 AS a, (l24 - 120) / 40 AS b, (y - 110) / 45 AS y FROM (
        SELECT y, lag(y, 1) OVER o AS l1, lag(y, 24) OVER o AS l24 FROM hourly_filled
        WINDOW o AS (PARTITION BY event_type ORDER BY timestamp)) WHERE l24 IS NOT NULL),
      hidden AS (SELECT *, greatest(0.0, 0.5 * a + 0.25 * b + 0.1) AS p, greatest(0.0, -0.25 * a + 0.75 * b - 0.2) AS q FROM inputs),
      errors AS (SELECT *, 0.6 * p + 0.4 * q + 0.05 - y AS d FROM hidden),
      back AS (SELECT *, CASE WHEN p > 0 THEN 0.6 * d ELSE 0 END AS dp, CASE WHEN q > 0 THEN 0.4 * d ELSE 0 END AS dq FROM errors),
      sums AS (SELECT count(*) AS n, [sum(a * dp), sum(a * dq), sum(b * dp), sum(b * dq), sum(dp), sum(dq), sum(p * d), sum(q * d), sum(d)] AS g
        FROM back),
      weights AS (SELECT unnest(range(9)) AS i, unnest([0.5, -0.25, 0.25, 0.75, 0.1, -0.2, 0.6, 0.4, 0.05]::DOUBLE[]) AS w,
        unnest([1, 1, 1, 1, 0, 0, 1, 1, 0]) * 1e-4 AS penalty),
      slopes AS (SELECT i::INTEGER AS i, n, w, (g[i + 1] + penalty * w) / n AS gradient FROM weights, sums WHERE n > 0)
      SELECT i, n, floor(gradient * 1e6 + 0.5001) / 1e6 AS gradient,
        floor((w - 1e-3 * gradient / (abs(gradient) + 1e-8 / sqrt(0.001))) * 1e6 + 0.5001) / 1e6 AS weight FROM slopes""",
)
def full_batch_step(spark, sf):
    series = hourly_filled(spark, sf).select("event_type", "timestamp", "y")
    lagged = windows.with_lags_and_means(series, "y", {"l1": 1, "l24": 24}, {}, keys=["event_type"])
    layout = mlp.Layout((2, 2, 1))
    return rounded(mlp.full_batch_step(lagged, layout, _FIXED["flat"], ["l1", "l24"], _FIXED["means"], _FIXED["spreads"]), lean=1e-4)


_BOTH = """preds AS (
  SELECT 'SeasonalNaive7' AS model, split, timestamp, y, demand_lag_7d AS y_hat FROM dataset
    WHERE split <> 'train' AND demand_lag_7d IS NOT NULL AND y IS NOT NULL
  UNION ALL SELECT 'LagRidge', split, timestamp, y, y_hat FROM scored WHERE y_hat IS NOT NULL AND y IS NOT NULL)"""
_BACKTEST = sql.ctes(sql.DATASET, _two_lag_fit(), _SCORED, _BOTH)
_ERRORS = """errors AS (SELECT model, split, sum(a) / sum(n) AS mae, sqrt(sum(s) / sum(n)) AS rmse,
    avg(peak) AS monthly_peak_mae, sum(n)::BIGINT AS n_samples FROM (
      SELECT model, split, sum(abs(y_hat - y)) AS a, sum((y_hat - y) * (y_hat - y)) AS s, count(*) AS n,
             abs(max(y_hat) - max(y)) AS peak FROM preds GROUP BY model, split, date_trunc('month', timestamp))
  GROUP BY 1, 2)"""
_MEASURED = [(split, m) for split in ("val", "test") for m in ("mae", "rmse", "monthly_peak_mae")]


def _wide(key: str = "") -> str:
    columns = [sql.lean(f"max(CASE WHEN split = '{s}' THEN {m} END)", 2) + f" AS {s}_{m}" for s, m in _MEASURED]
    columns += [f"max(CASE WHEN split = '{s}' THEN n_samples END) AS {s}_n_samples" for s in ("val", "test")]
    return f"SELECT {key} model, {', '.join(columns)} FROM errors GROUP BY {key} model"


def two_models(spark, sf):
    return written_dataset(spark, sf), [naive(), lag_ridge()]


@query(
    "e4_predictions",
    _BACKTEST + "SELECT timestamp, round(y, 3) AS y, round(y_hat, 3) AS y_hat, split FROM preds "
    "WHERE model = 'SeasonalNaive7' AND split = 'val'",
)
def prediction_table(spark, sf):
    dataset, models = two_models(spark, sf)
    preds = backtest.predictions(dataset, models)
    return rounded(backtest.prediction_table(preds, "SeasonalNaive7", "val"), 3)


@query("e1_e2_metrics_table", _BACKTEST.rstrip() + ", " + _ERRORS + _wide())
def metrics_table(spark, sf):
    dataset, models = two_models(spark, sf)
    preds = backtest.predictions(dataset, models)
    return rounded(backtest.metrics_table(preds, [m.name for m in models]), 2, lean=sql.LEAN)


@query(
    "e3_u3_strain_tables",
    _BACKTEST.rstrip()
    + """, t AS (SELECT quantile_cont(y, 0.95) AS threshold FROM dataset WHERE split = 'train')
    SELECT model, split, year(timestamp)::INTEGER AS year, quarter(timestamp)::INTEGER AS quarter,
      round(max(y), 2) AS actual_peak_mw, round(max(y_hat), 2) AS predicted_peak_mw,
      count(CASE WHEN y > threshold THEN 1 END) AS actual_high_hours,
      count(CASE WHEN y_hat > threshold THEN 1 END) AS predicted_high_hours,
      round(max(y_hat) - max(y), 2) + 0.0 AS peak_uplift_mw FROM preds, t GROUP BY 1, 2, 3, 4""",
)
def strain_tables(spark, sf):
    dataset, models = two_models(spark, sf)
    preds = backtest.predictions(dataset, models)
    return rounded(backtest.strain_tables(preds, backtest.high_threshold(dataset)), 2)


@query(
    "o2_e5_model_ranking",
    _BACKTEST.rstrip()
    + ", "
    + _ERRORS
    + f"SELECT model, {sql.lean('rmse', 2)} AS test_rmse FROM errors WHERE split = 'test' ORDER BY rmse, model",
)
def model_ranking(spark, sf):
    dataset, models = two_models(spark, sf)
    table = backtest.metrics_table(backtest.predictions(dataset, models), [m.name for m in models])
    return rounded(backtest.ranking(table).select("model", "test_rmse"), 2, lean=sql.LEAN)


def _ridge_sql(name: str, features: list[str], key: str, alpha: float = 1.0) -> str:
    """CTEs ``<name>_scored`` (key, split, timestamp, y, y_hat): the normal equations of ``features`` per key, solved
    by elimination (the matrix is positive definite, so pivots are taken in order)."""
    k, known = len(features), " AND ".join(f"{c} IS NOT NULL" for c in (*features, "y"))
    xs = ", ".join(f"{c}::DOUBLE" for c in features)
    return f"""{name}_rows AS (SELECT {key}, split, timestamp, y, [{xs}] AS x, [{xs}, y] AS v FROM inputs WHERE {known}),
{name}_means AS (
  SELECT {key}, list(m ORDER BY i) AS m FROM (
    SELECT {key}, i, avg(v[i]) AS m FROM {name}_rows, range(1, {k + 2}) AS t(i) WHERE split = 'train' GROUP BY 1, 2) GROUP BY 1),
{name}_gram AS (
  SELECT {key}, list(r ORDER BY i) AS a FROM (
    SELECT {key}, i, list(g ORDER BY j) AS r FROM (
      SELECT {key}, i, j, sum((v[i] - m[i]) * (v[j] - m[j])) + CASE WHEN i = j THEN {alpha} ELSE 0 END AS g
      FROM {name}_rows JOIN {name}_means USING ({key}), range(1, {k + 1}) AS t(i), range(1, {k + 2}) AS u(j)
      WHERE split = 'train' GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
{name}_steps AS (
  SELECT {key}, 1 AS s, a FROM {name}_gram
  UNION ALL
  SELECT {key}, s + 1, list_transform(a, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda e: e / r[s])
    ELSE list_transform(r, lambda e, j: e - r[s] * a[s][j] / a[s][s]) END)
  FROM {name}_steps WHERE s <= {k}),
{name}_coefs AS (
  SELECT {key}, m, list_transform(a, lambda r: r[{k + 1}]) AS b FROM {name}_steps JOIN {name}_means USING ({key}) WHERE s = {k + 1}),
{name}_scored AS (
  SELECT {key}, split, timestamp, y, m[{k + 1}] + list_sum(list_transform(b, lambda c, i: c * (x[i] - m[i]))) AS y_hat
  FROM {name}_rows JOIN {name}_coefs USING ({key}) WHERE split <> 'train')"""


_WEATHER_ALL = ["hdd_18", "cdd_18", "hour_sin", "hour_cos", "doy_sin", "doy_cos", "is_weekend", "years"]
_ALL_BY_NATION = f"""inputs AS (
  SELECT *, (epoch_us(timestamp) - epoch_us(TIMESTAMP '{DAY_ORIGIN}')) / ({DAYS_PER_YEAR} * 86400 * 1000000.0) AS years FROM dataset),
{_ridge_sql('lagged', _DAY_FEATURES, 'c_nationkey')},
{_ridge_sql('by_weather', _WEATHER_ALL, 'c_nationkey')},
preds AS (
  SELECT c_nationkey, 'SeasonalNaive7' AS model, split, timestamp, y, demand_lag_7d AS y_hat FROM dataset
    WHERE split <> 'train' AND demand_lag_7d IS NOT NULL AND y IS NOT NULL
  UNION ALL SELECT c_nationkey, 'LagRidge', split, timestamp, y, y_hat FROM lagged_scored
  UNION ALL SELECT c_nationkey, 'LinearWeatherRidge', split, timestamp, y, y_hat FROM by_weather_scored),
errors AS (SELECT c_nationkey, model, split, sum(a) / sum(n) AS mae, sqrt(sum(s) / sum(n)) AS rmse,
    avg(peak) AS monthly_peak_mae, sum(n)::BIGINT AS n_samples FROM (
      SELECT c_nationkey, model, split, sum(abs(y_hat - y)) AS a, sum((y_hat - y) * (y_hat - y)) AS s, count(*) AS n,
             abs(max(y_hat) - max(y)) AS peak FROM preds GROUP BY c_nationkey, model, split, date_trunc('month', timestamp))
  GROUP BY 1, 2, 3)
"""


@query(
    "e1_all_models_by_nation",
    "WITH RECURSIVE" + sql.ctes(sql.NATION_DATASET, _ALL_BY_NATION).lstrip().removeprefix("WITH") + _wide("c_nationkey,"),
)
def all_models_by_nation(spark, sf):
    dataset, keys = written_dataset_by_nation(spark, sf), ["c_nationkey"]
    models = [naive(), lag_ridge(_DAY_FEATURES), weather_ridge()]
    preds = backtest.predictions(dataset, models, keys)
    return rounded(backtest.metrics_table(preds, [m.name for m in models], keys), 2, lean=sql.LEAN)


@query(
    "e1_naive_metrics_by_nation",
    sql.ctes(sql.NATION_DATASET)
    + f"""SELECT c_nationkey, 'SeasonalNaive7' AS model,
      {sql.lean("avg(abs(demand_lag_7d - y)) FILTER (split = 'val')", 3)} AS val_mae,
      {sql.lean("avg(abs(demand_lag_7d - y)) FILTER (split = 'test')", 3)} AS test_mae,
      count(*) FILTER (split = 'val') AS val_n_samples, count(*) FILTER (split = 'test') AS test_n_samples
      FROM dataset WHERE split <> 'train' AND demand_lag_7d IS NOT NULL GROUP BY 1""",
)
def naive_metrics_by_nation(spark, sf):
    dataset, keys = written_dataset_by_nation(spark, sf), ["c_nationkey"]
    table = backtest.metrics_table(backtest.predictions(dataset, [naive()], keys), ["SeasonalNaive7"], keys)
    return rounded(table.select("c_nationkey", "model", "val_mae", "test_mae", "val_n_samples", "test_n_samples"), 3, lean=sql.LEAN)


@query(
    "u4_all_metrics",
    _BACKTEST.rstrip()
    + ", "
    + _ERRORS
    + f"""SELECT model, {sql.lean("rmse", 2)} AS val_rmse, NULL::DOUBLE AS test_rmse FROM errors
         WHERE split = 'val'
         UNION ALL SELECT model, NULL, {sql.lean("rmse", 2)} FROM errors WHERE split = 'test'""",
)
def all_metrics(spark, sf):
    dataset, models = two_models(spark, sf)
    table = backtest.metrics_table(backtest.predictions(dataset, models), [m.name for m in models])
    first, second = table.select("model", "val_rmse"), table.select("model", "test_rmse")
    return rounded(reports.all_metrics(first, second), 2, lean=sql.LEAN)


@query(
    "a7_training_threshold",
    sql.ctes(sql.DATASET) + "SELECT round(quantile_cont(y, 0.95), 3) AS threshold FROM dataset WHERE split = 'train'",
)
def training_threshold(spark, sf):
    return rounded(backtest.high_threshold(written_dataset(spark, sf)), 3)


@query(
    "a7_threshold_by_nation",
    sql.ctes(sql.NATION_DATASET)
    + """SELECT c_nationkey, round(quantile_cont(y, 0.95), 3) AS threshold FROM dataset WHERE split = 'train'
         GROUP BY 1""",
)
def threshold_by_nation(spark, sf):
    train = written_dataset_by_nation(spark, sf).where(F.col("split") == "train")
    return rounded(exact_percentile(train, "y", 0.95, ["c_nationkey"]), 3)

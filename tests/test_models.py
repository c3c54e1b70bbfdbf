import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.models import LagRidge, LinearWeatherRidge, PooledMLP, SeasonalNaive, mlp, ridge
from tidewatt.operators import keyed, metrics, quantile
from tidewatt.plans import backtest


def closed_form(x, y, alpha=1.0):
    xm, ym = x.mean(axis=0), y.mean()
    xc = x - xm
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - ym))
    return b, ym - xm @ b


@pytest.fixture(scope="module")
def frame(spark):
    """Two series of daily rows with weather and lag features, some of them unknown."""
    return spark.createDataFrame(
        _rows(),
        "k bigint, timestamp timestamp_ntz, y double, hdd_18 double, cdd_18 double, hour_sin double, hour_cos double,"
        " doy_sin double, doy_cos double, is_weekend boolean, demand_lag_1h double, demand_lag_24h double, split string",
    )


def _rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(1600):
        y = None if i % 97 == 5 else float(100 + 30 * np.sin(i / 9) + 5 * rng.random() + (i % 2) * 40)
        t = 30 * rng.random() - 5
        split = "train" if i < 1200 else "val" if i < 1400 else "test"
        out.append(
            (i % 2, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), y, max(0.0, 18 - t), max(0.0, t - 18),
             float(np.sin(i / 9)), float(np.cos(i / 9)), float(np.sin(i / 90)), float(np.cos(i / 90)), i % 7 > 4,
             None if i < 10 else float(100 + 20 * rng.random()), float(90 + 20 * rng.random()), split)
        )
    return out


@pytest.mark.parametrize("model", [LinearWeatherRidge(), LinearWeatherRidge(include_trend=False), LagRidge()])
def test_ridge_equals_closed_form(frame, model):
    train = frame.where("split = 'train'")
    rows, features = model.inputs(train)
    pdf = rows.toPandas().dropna(subset=[*features, "y"])
    b, b0 = closed_form(pdf[features].to_numpy(dtype=float), pdf["y"].to_numpy())
    params = model.fit(train)
    got = params.first()
    assert got.n_samples == len(pdf)
    np.testing.assert_allclose(got.coefs, b, rtol=1e-8, atol=1e-9)
    np.testing.assert_allclose(got.intercept, b0, rtol=1e-8)
    scored = model.transform(frame, params).toPandas()
    whole = model.inputs(frame)[0].toPandas()
    expected = whole[features].to_numpy(dtype=float) @ b + b0
    np.testing.assert_allclose(scored["y_hat"].to_numpy(dtype=float), expected, rtol=1e-8, equal_nan=True)


def test_ridge_per_series(frame):
    model, train = LagRidge(), frame.where("split = 'train'")
    params = {r.k: r for r in model.fit(train, ["k"]).collect()}
    for k in (0, 1):
        alone = model.fit(train.where(F.col("k") == k)).first()
        np.testing.assert_allclose(params[k].coefs, alone.coefs, rtol=1e-9)
    scored = model.transform(frame, model.fit(train, ["k"]), ["k"])
    assert scored.count() == 1600
    assert scored.where("y_hat IS NULL").count() == 10


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_models_fitted_together_are_as_alone(frame, keys):
    """Each model counts its own complete rows; two trends of different origin do not mix."""
    models = [LagRidge(), LinearWeatherRidge(), LinearWeatherRidge(trend_origin="2020-01-01 00:00:00"), LagRidge(3.0, ["demand_lag_24h"])]
    train = frame.where("split = 'train'").withColumn("hdd_18", F.when(F.col("hdd_18") < 9, F.col("hdd_18")))
    params = ridge.fit_together(train, models, keys)
    together = ridge.transform_together(frame, models, params, ["a", "b", "c", "d"], keys).orderBy("timestamp").toPandas()
    assert list(together.columns) == [*frame.columns, "a", "b", "c", "d"]
    for name, model in zip("abcd", models):
        alone = model.transform(frame, model.fit(train, keys), keys).orderBy("timestamp").toPandas()
        np.testing.assert_allclose(together[name].astype(float), alone["y_hat"].astype(float), rtol=1e-9, equal_nan=True)
    counts = params.selectExpr("n_samples_0 AS a", "n_samples_1 AS b").collect()
    assert all(r.a > r.b > 0 for r in counts)


def test_a_model_without_rows_leaves_the_others(frame):
    train = frame.where("split = 'train'").withColumn("hdd_18", F.lit(None).cast("double"))
    models = [LinearWeatherRidge(), LagRidge()]
    scored = ridge.transform_together(frame, models, ridge.fit_together(train, models, ["k"]), ["a", "b"], ["k"])
    assert scored.where("a IS NOT NULL").count() == 0 and scored.where("b IS NOT NULL").count() == 1590


def test_back_test_scans_the_training_rows_once(spark, frame, tmp_path):
    path = f"{tmp_path}/frame"
    frame.write.parquet(path)
    models = [SeasonalNaive("demand_lag_24h"), LagRidge(), LinearWeatherRidge(), LinearWeatherRidge(2.0, False)]
    preds = backtest.predictions(spark.read.parquet(path), models, ["k"])
    plan = preds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2  # the training rows, and those to score
    assert plan.count("MapInPandas") == 1


def test_ridge_without_complete_rows_forecasts_nothing(frame):
    model = LagRidge()
    params = model.fit(frame.where("timestamp < timestamp_ntz'2020-01-01 05:00:00'"))
    assert params.count() == 0
    assert model.transform(frame, params).where("y_hat IS NOT NULL").count() == 0


def test_missing_inputs_are_named(frame):
    with pytest.raises(ValueError, match="hdd_18"):
        LinearWeatherRidge().fit(frame.drop("hdd_18"))
    with pytest.raises(ValueError, match="demand_lag_168h"):
        SeasonalNaive().transform(frame)


def test_gradient_is_the_slope_of_the_loss():
    layout = mlp.Layout((3, 4, 2, 1))
    rng = np.random.default_rng(0)
    flat, x, y = rng.normal(size=layout.count), rng.normal(size=(20, 3)), rng.normal(size=20)

    def loss(f):
        layers = layout.split(f)
        penalty = sum((w * w).sum() for w, _ in layers) * 0.01 / len(x) / 2
        return 0.5 * np.mean((mlp.forward(layers, x)[-1][:, 0] - y) ** 2) + penalty

    got = mlp.gradient(layout, flat, x, y, 0.01)
    for i in range(layout.count):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - got[i]) < 1e-6


def test_network_learns_and_round_trips(frame, spark, tmp_path):
    model = PooledMLP(hidden=(16, 8), max_rounds=25, partitions=2, learning_rate=0.01, batch_size=64)
    params = model.fit(frame.where("split = 'train'"))
    params.write.parquet(f"{tmp_path}/p")
    scored = model.transform(frame, spark.read.parquet(f"{tmp_path}/p"))
    errors = scored.where("split <> 'train'").agg(
        F.sqrt(F.avg(F.pow(F.col("y_hat") - F.col("y"), F.lit(2)))), F.stddev("y")
    ).first()
    assert errors[0] < 0.75 * errors[1]
    assert scored.where("y_hat IS NULL").count() == 10
    assert mlp.read_parameters(params)[2] == sorted(
        ["k", "hdd_18", "cdd_18", "hour_sin", "hour_cos", "doy_sin", "doy_cos", "is_weekend", "demand_lag_1h", "demand_lag_24h"]
    )


def _rmse(scored):
    return scored.where("y IS NOT NULL").agg(F.sqrt(F.avg(F.pow(F.col("y_hat") - F.col("y"), F.lit(2))))).first()[0]


def test_network_without_held_out_rows_is_judged_by_those_that_train(frame):
    train = frame.where("split = 'train'")
    how = {"hidden": (16, 8), "max_rounds": 20, "partitions": 2, "learning_rate": 0.01, "batch_size": 64}
    some, none = PooledMLP(**how), PooledMLP(**how, holdout=0.0)
    with_some, with_none = (_rmse(m.transform(train, m.fit(train))) for m in (some, none))
    assert with_none < 1.2 * with_some


def test_network_scales_by_all_complete_rows_and_repeats(frame):
    train = frame.where("split = 'train'")
    how = {"hidden": (4,), "max_rounds": 2, "partitions": 3}
    one, two = (PooledMLP(**how).fit(train).orderBy("part", "layer", "row", "col").toPandas() for _ in range(2))
    np.testing.assert_array_equal(one["value"], two["value"])
    features = one.loc[(one["part"] == "mean") & (one["name"] != "y"), "name"].tolist()
    rows = train.dropna(subset=[*features, "y"]).toPandas()
    for part, how_ in (("mean", np.mean), ("std", np.std)):
        own = one[one["part"] == part].set_index("name")["value"]
        np.testing.assert_allclose(own[features], [how_(rows[f].to_numpy(float)) for f in features])


def test_network_stops_early(frame):
    model = PooledMLP(hidden=(4,), max_rounds=200, patience=2, min_gain=0.05, partitions=2, learning_rate=0.02)
    model.fit(frame.where("split = 'train'"))
    assert 3 < model.rounds < 100


class Zero:
    """A model of the user's own."""

    name = "Zero"

    def fit(self, df, keys=()):
        return None

    def transform(self, df, params, keys=()):
        return df.withColumn("y_hat", F.lit(0.0))


def test_backtest_takes_any_model_and_reports_empty_splits(frame):
    only_val = frame.where("split <> 'test'")
    table = backtest.evaluate(only_val, [Zero(), LagRidge()])["metrics"]
    rows = {r.model: r for r in table.collect()}
    y = np.array([r.y for r in only_val.where("split = 'val' AND y IS NOT NULL").select("y").collect()])
    np.testing.assert_allclose(rows["Zero"].val_rmse, np.sqrt(np.mean(y**2)))
    assert rows["Zero"].val_n_samples == len(y)
    assert (rows["Zero"].test_n_samples, rows["Zero"].test_mae) == (0, None)


def test_a_model_without_rows_is_listed_for_each_series(frame):
    preds = backtest.predictions(frame, [Zero()], ["k"])
    table = backtest.metrics_table(preds, ["Zero", "Other"], ["k"]).orderBy("k", "model")
    assert [(r.k, r.model, r.val_n_samples > 0) for r in table.collect()] == [(0, "Other", False), (0, "Zero", True), (1, "Other", False), (1, "Zero", True)]


def test_monthly_peaks_need_not_share_the_hour(series):
    df = series(y=[10, 20], y_hat=[25, 5])
    assert metrics.monthly_peak_mae(df).first()[0] == 5
    assert metrics.forecast_errors(df).first().monthly_peak_mae == 5
    assert metrics.forecast_errors(df.where("y > 99")).first().n_samples == 0


# --- exact percentile and attached tables ------------------------------------------


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("n", [1, 2, 4, 37, 30_000])
def test_percentile_equals_numpy(spark, n, p):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(3, 2, n), 3)
    df = spark.createDataFrame([(float(v),) for v in values], "y double")
    got = quantile.exact_percentile(df, "y", p).first()[0]
    np.testing.assert_allclose(got, np.percentile(values, 100 * p), rtol=1e-12)


def test_percentile_per_group_with_a_hot_group(spark):
    df = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id % 50 END AS k", "CASE WHEN id % 11 = 0 THEN NULL ELSE hash(id) / 1000D END AS y"
    )
    got = {r.k: r.threshold for r in quantile.exact_percentile(df, "y", 0.95, ["k"]).collect()}
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("y", 0.95).alias("p")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) < 1e-6
    rough = quantile.rough_percentile(df, "y", 0.95, ["k"]).count()
    assert rough == len(want)


def frames_written(monkeypatch):
    """The frames that exact percentiles write, in order."""
    written, write = [], quantile.staged

    def keep(df, name):
        written.append((name, df))
        return write(df, name)

    monkeypatch.setattr(quantile, "staged", keep)
    return written


def test_percentile_scans_twice_without_a_window(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/values"
    spark.range(20_000).selectExpr("id % 3 AS k", "hash(id) / 7D AS y").write.parquet(path)
    written = frames_written(monkeypatch)
    out = quantile.exact_percentile(spark.read.parquet(path), "y", 0.95, ["k"])
    plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in [*written, ("end", out)]}
    assert sum(plan.count(f"{path}]") for plan in plans.values()) == 2  # the sketch, and the counts
    assert not any("Window" in plan or "percentile(" in plan for plan in plans.values())


def test_order_key_orders_as_doubles_do(spark):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    values = bits.view(float)
    powers = 2.0 ** np.arange(-1074, 1024)
    near = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf)])
    values = np.concatenate([values[~np.isnan(values)], near, -near, [0.0, -0.0, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "y double")
    got = np.array([r.k for r in df.select(quantile.order_key(F.col("y")).alias("k")).collect()])
    raw = (values + 0.0).view(np.int64)  # sign and magnitude
    assert np.array_equal(got, np.where(raw < 0, -(raw & np.int64(2**63 - 1)), raw))
    assert spark.sql("SELECT double('NaN') AS y").select(quantile.order_key(F.col("y"))).first()[0] > got.max()


@pytest.mark.parametrize("tail", ["wide", "narrow", "nested", "signs"])
def test_ranks_of_hard_distributions(spark, tail, monkeypatch):
    rng = np.random.default_rng(9)
    n = 30_000
    values = {
        "wide": 10.0 ** rng.uniform(-300, 300, n),
        "narrow": 1e6 + rng.permutation(n) * 2.0**-30,
        "nested": np.where(rng.random(n) < 0.5, 1 + rng.random(n) * 1e-12, rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-300, 300, n)),
        "signs": rng.normal(0, 1e-200, n),
    }[tail]
    df = spark.createDataFrame([(float(v),) for v in values], "y double")
    written = frames_written(monkeypatch)
    got = quantile.exact_percentiles(df, "y", {"a": 0.05, "b": 0.5, "c": 0.5001, "d": 0.95}).first()
    ordered = np.sort(values)
    for name, p in {"a": 0.05, "b": 0.5, "c": 0.5001, "d": 0.95}.items():
        place = (n - 1) * p
        low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
        assert got[name] == low + (high - low) * (place - np.floor(place))
    assert sum(name == "ranks" for name, _ in written) <= 7


def test_profile_has_no_window_and_equals_pandas(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 5000, p=[0.7, 0.2, 0.1]), "x": rng.choice(rng.normal(5, 3, 400), 5000)})
    pdf.loc[::13, "x"] = np.nan
    df = spark.createDataFrame([(k, None if np.isnan(x) else float(x)) for k, x in zip(pdf.k, pdf.x)], "k string, x double")
    written = frames_written(monkeypatch)
    out = metrics.value_profile(df, "x", ["k"])
    assert not any("Window" in f._jdf.queryExecution().executedPlan().toString() for _, f in [*written, ("end", out)])
    for row in out.collect():
        x = pdf[pdf.k.isna() if row.k is None else pdf.k == row.k].x.dropna()
        want = (len(x), x.nunique(), x.mean(), x.std(), x.min(), x.max(), *np.percentile(x, [25, 50, 75]))
        np.testing.assert_allclose([row["count"], *row[2:]], want, rtol=1e-12)


@pytest.mark.parametrize("p", [0.5, 0.9, 0.999])
def test_percentile_of_a_heavy_tail(spark, p):
    values = np.exp(np.random.default_rng(5).normal(0, 12, 20_000))
    df = spark.createDataFrame([(float(v),) for v in values], "y double")
    np.testing.assert_allclose(quantile.exact_percentile(df, "y", p).first()[0], np.percentile(values, 100 * p), rtol=1e-9)


def test_percentile_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "y double")
    assert quantile.exact_percentile(df, "y", 0.95).first()[0] is None


def test_attach_keeps_every_row(spark):
    df = spark.range(100).selectExpr("id % 4 AS k", "id")
    small = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k bigint, v double")
    rows = keyed.attach(df, small, ["k"], ["id"]).collect()
    assert len(rows) == 100 and {r.k: r.v for r in rows} == {0: 1.0, 1: 2.0, 2: None, 3: None}


def test_training_repeats_to_the_last_bit(spark):
    """The same rows in other file splits and another order give the same weights."""
    rng = np.random.default_rng(3)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(a), float(b), float(3 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    schema = "timestamp timestamp_ntz, a double, b double, y double"
    weights = []
    for order, splits in ((rows, 1), (rows[::-1], 7), (rows, 4)):
        df = spark.createDataFrame(order, schema).repartition(splits)
        model = mlp.PooledMLP(hidden=(4,), max_rounds=3, partitions=5, features=["a", "b"])
        weights.append(mlp.read_parameters(model.fit(df))[1:])
    for flat, _, means, spreads in weights[1:]:
        for got, want in zip((flat, means, spreads), (weights[0][0], weights[0][2], weights[0][3])):
            assert got.tobytes() == want.tobytes()
    xs = np.array([r[1:] for r in rows])
    np.testing.assert_allclose(weights[0][2], xs.mean(axis=0), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(weights[0][3], xs.std(axis=0), rtol=1e-9)

import hashlib

import numpy as np
import pandas as pd
import pytest
from series_frames import hours, to_spark
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gustline.operators import explain, inference, linear, metrics, registry, selection, splits, summary
from gustline.operators.explain import linear_attribution
from gustline.operators.windows import build_features
from gustline.spec import Contract, FeatureSpec, LinearModel

COLS = ["temperature", "pm25_lag_1", "pm25_lag_3", "pm25_lag_24", "pm25_roll_mean_6", "pm25_roll_mean_24",
        "hour_sin", "hour_cos"]


@pytest.fixture(scope="module")
def table(spark, ar_series):
    df = build_features(to_spark(spark, ar_series), FeatureSpec(), ["series"])
    return df.select("series", "datetime", "pm25", *COLS).persist()


# -- splits ---------------------------------------------------------------------------------
@pytest.mark.parametrize("n,test", [(100, 24), (1000, 150)])
def test_holdout_sizes(spark, n, test):
    df = to_spark(spark, pd.DataFrame({"series": "a", "datetime": hours(n), "pm25": 1.0}))
    got = splits.holdout(df, ["series"]).where("role = 'test'")
    assert got.count() == test
    assert got.agg(F.min("datetime")).first()[0] == hours(n)[n - test]


def test_folds(spark):
    df = to_spark(spark, pd.DataFrame({"series": "a", "datetime": hours(100), "pm25": 1.0}))
    folds = splits.ts_folds(df, ["series"]).toPandas()
    for fold, end in ((1, 25), (2, 50), (3, 75)):
        f = folds[folds["fold"] == fold]
        train, val = f[f["role"] == "train"]["datetime"], f[f["role"] == "val"]["datetime"]
        assert len(train) == end and len(val) == 25 and train.max() < val.min()
        assert train.max() == hours(100)[end - 1]


def test_recent_split(spark):
    df = to_spark(spark, pd.DataFrame({"series": ["a"] * 100 + ["b"] * 50, "datetime": [*hours(100), *hours(50)], "pm25": 1.0}))
    got = {(r["series"], r["role"]): r["n"] for r in
           splits.split_recent(df, ["series"]).groupBy("series", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("a", "recent"): 72, ("a", "reference"): 28, ("b", "recent"): 50}
    assert {r["series"]: r["enough"] for r in splits.enough_rows(df, ["series"]).collect()} == {"a": True, "b": False}


# -- linear models --------------------------------------------------------------------------
def standardised(x):
    s = x.std(axis=0)
    return x.mean(axis=0), np.where(s > 0, s, 1.0)


def ridge_fit(x, y, alpha):
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return lambda z: ym + (z - xm) @ w


def expanding(n, k):
    step = n // (k + 1)
    return [(slice(0, n - (k + 1 - i) * step), slice(n - (k + 1 - i) * step, n - (k - i) * step)) for i in range(1, k + 1)]


def rmse(a, b):
    return float(np.sqrt(np.mean((a - b) ** 2)))


def ridge_by_hand(pdf, top):
    """Straightforward nested selection, scaling and tuning over the rows of one series."""
    x_all, y_all = pdf[COLS].to_numpy(), pdf["pm25"].to_numpy()
    dev = len(pdf) - max(int(0.15 * len(pdf)), 24)
    for tr, va in [*expanding(dev, 3), (slice(0, dev), slice(dev, len(pdf)))]:
        x, y = x_all[tr], y_all[tr]
        r = np.abs([np.corrcoef(x[:, j], y)[0, 1] for j in range(len(COLS))])
        chosen = sorted(np.argsort(r)[::-1][:top])
        chosen += [COLS.index(m) for m in linear.MUST_HAVE if COLS.index(m) not in chosen]
        mean, std = standardised(x[:, chosen])
        z, zv = (x[:, chosen] - mean) / std, (x_all[va][:, chosen] - mean) / std
        score = {a: np.mean([rmse(y[v], ridge_fit(z[t], y[t], a)(z[v])) for t, v in expanding(len(y), 3)])
                 for a in linear.RIDGE_ALPHAS}
        alpha = min(score, key=score.get)
        model = ridge_fit(z, y, alpha)
        yield ([COLS[j] for j in chosen], alpha, rmse(y, model(z)), rmse(y_all[va], model(zv)),
               1 - np.sum((y_all[va] - model(zv)) ** 2) / np.sum((y_all[va] - y_all[va].mean()) ** 2))


def test_ridge_equals_the_row_by_row_computation(table):
    got = linear.ridge_cv(table, "pm25", COLS, ["series"], top=5).toPandas()
    rows = table.toPandas().sort_values("datetime")
    for name in ("a", "b"):
        mine = got[got["series"] == name].set_index("fold")
        for fold, want in zip((1, 2, 3, 0), ridge_by_hand(rows[rows["series"] == name], 5)):
            r = mine.loc[fold]
            assert list(r["features"]) == want[0] and r["alpha"] == want[1]
            assert (r["train_rmse"], r["val_rmse"], r["val_r2"]) == pytest.approx(want[2:], abs=1e-4)


def test_scoring_with_the_fitted_models(table):
    models = linear.ridge_cv(table, "pm25", COLS, ["series"]).where("fold = 0")
    scored = linear.score_models(splits.holdout(table, ["series"]), models, COLS, ["series"])
    got = {(r["series"], r["role"]): r["rmse"] for r in
           metrics.regression_metrics(scored, "pm25", "predicted", ["series", "role"]).collect()}
    for r in models.collect():
        assert got[(r["series"], "dev")] == pytest.approx(r["train_rmse"], abs=2e-4)
        assert got[(r["series"], "test")] == pytest.approx(r["val_rmse"], abs=2e-4)
        assert r["val_r2"] > 0.5


def test_lasso_equals_spark_ml(table):
    got = linear.lasso_cv(table, "pm25", COLS, ["series"], alphas=[0.1]).where("series = 'a'").first()
    pdf = table.where("series = 'a'").toPandas().sort_values("datetime")
    train = pdf.iloc[:-168]
    mean, std = standardised(train[COLS].to_numpy())
    scaled = table.sparkSession.createDataFrame(
        pd.DataFrame((train[COLS] - mean) / std, columns=COLS).assign(y=train["pm25"].to_numpy()))
    fit = LinearRegression(elasticNetParam=1.0, regParam=0.1, standardization=False, labelCol="y", featuresCol="v",
                           solver="l-bfgs", maxIter=1000, tol=1e-12).fit(
        VectorAssembler(inputCols=COLS, outputCol="v").transform(scaled))
    np.testing.assert_allclose(got["coefs"], fit.coefficients.toArray(), atol=2e-4)
    ranked = linear.coef_ranking(table.sparkSession.createDataFrame([got]), ["series"], nonzero=True).collect()
    assert all(r["coef"] != 0 for r in ranked)


def test_ridge_two_closed_form(table):
    got = linear.ridge_two(table, "pm25", ["pm25_lag_1", "temperature"], 10.0, ["series"]).where("series = 'b'").first()
    pdf = table.where("series = 'b'").toPandas()
    x, y = pdf[["pm25_lag_1", "temperature"]].to_numpy(), pdf["pm25"].to_numpy()
    mean, std = standardised(x)
    z = (x - mean) / std
    want = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))
    assert (got["coef_pm25_lag_1"], got["coef_temperature"]) == pytest.approx(tuple(want))


def test_constant_columns_have_no_correlation(spark):
    pdf = pd.DataFrame({"series": "a", "y": [1.0, 2.0, 4.0, 3.0, None], "flat": 99.0, "line": [2.0, 4.0, 8.0, 6.0, 1.0],
                        "x": [1.0, 3.0, 2.0, 5.0, 9.0], "once": [7.0, 7.0, 7.0, 7.0, 8.0]})
    df, cols = spark.createDataFrame(pdf).replace(float("nan"), None), ["flat", "line", "x", "once"]
    r = np.corrcoef(pdf["x"][:4], pdf["y"][:4])[0, 1]
    top = summary.top_correlations(df, "y", cols, k=4).collect()
    assert [(c["feature"], c["abs_corr"]) for c in top] == [("line", pytest.approx(1)), ("x", pytest.approx(r)), ("flat", None), ("once", None)]
    assert summary.abs_correlations(df, "y", cols, ["series"]).where("abs_corr is null").count() == 2
    picked = selection.select_f_regression(df, "y", cols, k=2, must_have=["flat"], by=["series"])
    found = {c["feature"]: c for c in picked.collect()}
    assert found["line"]["f_score"] > 1e12 and found["x"]["f_score"] == pytest.approx(r * r / (1 - r * r) * 2)
    assert (found["flat"]["r"], found["flat"]["f_score"], found["flat"]["place"]) == (None, None, 3)
    assert selection.selected_names(picked, ["series"]).first()["features"] == ["line", "x", "flat"]


@pytest.fixture(scope="module")
def flat_in_parts(spark):
    """A constant column in 30 tasks of 23 rows: 99 / 23 * 23 is not 99, so that means merged from them leave it a spread."""
    return spark.range(0, 690, 1, 30).select(
        F.lit("a").alias("series"), F.lit(99.0).alias("humidity"), F.lit(0.5).alias("co"),
        (F.col("id") % 7).cast("double").alias("pm25_lag_1"), (F.col("id") * F.col("id") % 101).cast("double").alias("y"))


def test_selection_of_a_constant_column_in_parts(flat_in_parts):
    picked = selection.select_f_regression(flat_in_parts, "y", ["humidity", "co", "pm25_lag_1"], k=3, must_have=[], by=["series"])
    found = {c["feature"]: (c["r"], c["f_score"], c["rank"]) for c in picked.collect()}
    assert found["humidity"] == (None, None, 3) and found["co"] == (None, None, 2)
    assert found["pm25_lag_1"][2] == 1 and found["pm25_lag_1"][1] > 0


def test_names_without_a_constant_column_in_parts(flat_in_parts):
    picked = selection.select_f_regression(flat_in_parts, "y", ["humidity", "co", "pm25_lag_1"], k=2, must_have=[], by=["series"])
    assert selection.selected_names(picked, ["series"]).first()["features"] == ["co", "pm25_lag_1"]


def test_importance_without_a_constant_column_in_parts(flat_in_parts):
    found = summary.abs_correlations(flat_in_parts, "y", ["humidity", "co", "pm25_lag_1"], ["series"]).where("abs_corr is not null")
    shares = summary.importance_share(found.withColumnRenamed("abs_corr", "importance"), ["series"])
    assert [(c["feature"], c["pct"], c["cumulative"], c["rank"]) for c in shares.collect()] == [("pm25_lag_1", 1.0, 1.0, 1)]


def test_family_share_without_a_constant_column_in_parts(flat_in_parts):
    found = summary.abs_correlations(flat_in_parts, "y", ["humidity", "co", "pm25_lag_1"], ["series"]).where("abs_corr is not null")
    shares = summary.importance_share(found.withColumnRenamed("abs_corr", "importance"), ["series"])
    assert [(c["series"], c["share"]) for c in summary.family_share(shares, ["series"]).collect()] == [("a", 1.0)]


# -- roll-ups and selection: known results ----------------------------------------------------
# Fold results (train RMSE, validation RMSE, train R², validation R², ratio) of three
# models and the roll-up they have to give.
FOLDS = {
    "ridge": [(2.6433, 5.1975, .9742, .8424, 1.9663), (2.1019, 2.0642, .9806, .9724, .9821), (2.0585, 1.635, .981, .9735, .7943)],
    "random_forest": [(3.4112, 4.9877, .957, .8548, 1.4622), (3.2275, 3.8488, .9543, .9041, 1.1925), (3.1469, 3.2044, .9557, .8982, 1.0183)],
    "xgboost": [(1.6149, 3.7903, .9904, .9162, 2.3471), (1.248, 2.273, .9932, .9666, 1.8213), (1.0565, 1.6149, .995, .9741, 1.5286)],
}
ROLLUPS = {
    "ridge": (.9786, .9294, .0492, .9821, "VERY GOOD"),
    "random_forest": (.9557, .8857, .07, 1.1925, "ACCEPTABLE"),
    "xgboost": (.9929, .9523, .0406, 1.8213, "VERY GOOD"),
}
# A leaderboard (MAE, RMSE, R², test gap, CV R², CV gap).
BOARD = [("xgboost", 2.6376, 4.4932, .9376, .056, .9523, .0406), ("lightgbm", 2.3203, 3.9241, .9524, .0438, .9498, .045),
         ("ridge", 1.4992, 2.0858, .9865, -.0042, .9294, .0492), ("random_forest", 2.8511, 4.3433, .9417, .0137, .8857, .07)]
BOARD_SCHEMA = "model string, mae double, rmse double, r2 double, r2_gap double, cv_val_r2 double, cv_gap double"


def test_cv_rollup_goldens(spark):
    rows = [(m, i, *f) for m, fs in FOLDS.items() for i, f in enumerate(fs, 1)]
    df = spark.createDataFrame(rows, "model string, fold int, train_rmse double, val_rmse double, train_r2 double, val_r2 double, ratio double")
    for r in metrics.cv_rollup(df, ["model"]).collect():
        assert (r["mean_train_r2"], r["mean_val_r2"], r["r2_gap"], r["rmse_ratio_median"], r["verdict"]) == ROLLUPS[r["model"]]


def test_selection_goldens(spark):
    board = spark.createDataFrame(BOARD, BOARD_SCHEMA)
    assert registry.select_best(board).first()["model"] == "ridge"
    assert registry.select_best(board, policy="min_gap").first()["model"] == "xgboost"
    assert registry.select_best(board, policy="cv_val_r2").first()["model"] == "xgboost"
    worse = board.withColumn("cv_gap", F.col("cv_gap") + 0.2)
    assert registry.select_best(worse).first()["model"] == "ridge"
    without_gap = board.withColumn("cv_gap", F.when(F.col("model") != "ridge", F.col("cv_gap")))
    assert registry.select_best(without_gap).first()["model"] == "lightgbm"


def test_promote_and_registry(spark):
    best = registry.select_best(spark.createDataFrame(BOARD, BOARD_SCHEMA))
    records = spark.createDataFrame([("ridge", ["pm25_lag_1", "hour"])], "model string, features array<string>")
    c = registry.promote(best, records).first()
    assert c["requires_scaling"] and c["features"] == ["pm25_lag_1", "hour"] and c["test_metrics"]["rmse"] == 2.0858
    reg = spark.createDataFrame([("ridge", 1, 2.0)], "model string, version int, rmse double")
    reg = registry.registry_append(reg, spark.createDataFrame([("ridge", 1.5), ("xgboost", 3.0)], "model string, rmse double"))
    assert {(r["model"], r["version"], r["rmse"]) for r in registry.registry_latest(reg).collect()} == {("ridge", 2, 1.5), ("xgboost", 1, 3.0)}


def test_records_without_test_rows_are_left_out(spark):
    cv = spark.createDataFrame([("m", .9, .8, .1, "ACCEPTABLE", 1.0, 3)], "model string, mean_train_r2 double, mean_val_r2 double, r2_gap double, verdict string, rmse_ratio_median double, n_splits int")
    sides = spark.createDataFrame([("m", "dev", 1.0, 2.0, .9), ("m", "test", 1.5, 2.5, .7), ("x", "dev", 1.0, 2.0, .9)],
                                  "model string, role string, mae double, rmse double, r2 double")
    rows = metrics.leaderboard_rows(metrics.metrics_record(cv, sides, ["model"])).collect()
    assert [(r["model"], r["rmse"], r["r2_gap"], r["cv_gap"]) for r in rows] == [("m", 2.5, .2, .1)]


# -- forecasts ------------------------------------------------------------------------------
FORECASTER = LinearModel(
    Contract("ridge", ["pm25_lag_1", "pm25_lag_24", "pm25_roll_mean_6", "pm25_roll_std_3", "temperature", "hour_sin"]),
    coefs=[0.4, 0.2, 0.25, 0.05, 0.1, 1.5], intercept=6.0)


def forecast_by_hand(past, future):
    past, out = list(past), []
    for ts, temperature in future:
        lag24 = past[-24] if len(past) >= 24 else past[-1]
        std = np.std(past[-3:], ddof=1) if len(past[-3:]) > 1 else 0.0
        y = (6 + .4 * past[-1] + .2 * lag24 + .25 * np.mean(past[-6:]) + .05 * std + .1 * temperature
             + 1.5 * np.sin(2 * np.pi * ts.hour / 24))
        past.append(y)
        out.append(y)
    return out


@pytest.fixture(scope="module")
def past_and_future(spark):
    rng = np.random.default_rng(1)
    sizes = {"long": (60, 72), "short": (5, 30), "one": (1, 3)}
    past = pd.concat([pd.DataFrame({"series": s, "datetime": hours(n), "pm25": rng.uniform(10, 60, n)}) for s, (n, _) in sizes.items()])
    future = pd.concat([pd.DataFrame({"series": s, "datetime": hours(h, hours(n + 1)[-1]), "step": range(1, h + 1),
                                      "temperature": rng.uniform(0, 30, h)}) for s, (n, h) in sizes.items()])
    return past, future


def check_forecast(got, past, future):
    got = got.toPandas().sort_values(["series", "hour"])
    for s in past["series"].unique():
        f = future[future["series"] == s]
        want = forecast_by_hand(past[past["series"] == s]["pm25"], zip(f["datetime"], f["temperature"]))
        mine = got[got["series"] == s]
        np.testing.assert_allclose(mine["predicted_pm25"], np.round(want, 2), atol=0.0101)
        assert mine["datetime"].tolist() == f["datetime"].tolist() and mine["category"].notna().all()


def test_linear_forecast_equals_the_loop(spark, past_and_future):
    past, future = past_and_future
    check_forecast(inference.forecast_linear(to_spark(spark, past), to_spark(spark, future), FORECASTER, ["series"]), past, future)


def test_step_forecast_equals_the_loop(spark, past_and_future):
    past, future = past_and_future
    got = inference.forecast_with_model(
        to_spark(spark, past), to_spark(spark, future), lambda d: inference.score_linear(d, FORECASTER),
        FORECASTER.contract.features, ["series"], horizon=30)
    check_forecast(got, past, future[future["step"] <= 30])


def test_missing_forecast_feature(spark, past_and_future):
    past, future = (to_spark(spark, p) for p in past_and_future)
    model = LinearModel(Contract("m", ["pm25_lag_1", "ozone"]), [1.0, 1.0], 0.0)
    with pytest.raises(ValueError, match="ozone"):
        inference.forecast_linear(past, future, model, ["series"])
    with pytest.raises(ValueError, match="lag"):
        inference.forecast_linear(past, future, LinearModel(Contract("m", ["pm25_lag_2"]), [1.0], 0.0), ["series"])


def test_scoring_checks_the_contract(table):
    model = LinearModel(Contract("m", ["pm25_lag_1"], requires_scaling=True), [2.0], 1.0, [10.0], [5.0])
    row = inference.score_linear(table, model).first()
    assert row["predicted"] == pytest.approx(1 + 2 * (row["pm25_lag_1"] - 10) / 5)
    with pytest.raises(ValueError, match="columns that are not there"):
        inference.score_linear(table.drop("pm25_lag_1"), model)
    with pytest.raises(RuntimeError):
        inference.score_linear(table, LinearModel(Contract("m", ["pm25_lag_1"], requires_scaling=True), [2.0], 1.0))
    back = inference.backtest(table, model, ["series"]).groupBy("series").count().collect()
    assert {r["count"] for r in back} == {72}


def test_linear_attribution(table):
    model = LinearModel(Contract("m", ["pm25_lag_1", "temperature"]), [2.0, -1.0], 1.0)
    got = {r["feature"]: r["mean_abs_shap"] for r in linear_attribution(table, model, ["series"]).where("series = 'a'").collect()}
    last = {r["feature"]: r["mean_abs_shap"] for r in linear_attribution(table, model, ["series"], 200).where("series = 'a'").collect()}
    rows = table.where("series = 'a'").toPandas().sort_values("datetime")
    for some, found in ((rows, got), (rows.tail(200), last)):
        for c, w in (("pm25_lag_1", 2), ("temperature", -1)):
            assert found[c] == pytest.approx(np.mean(np.abs(w * (some[c] - some[c].mean()))))


@pytest.mark.parametrize("bucket_rows", [8192, 16])
def test_permutation_order_is_that_of_the_whole_series(spark, monkeypatch, bucket_rows):
    """A long series beside short ones and a single row, cut into many buckets or none."""
    rng = np.random.default_rng(3)
    pdf = pd.concat([pd.DataFrame({"series": s, "datetime": hours(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
                     for s, n in (("x", 900), ("y", 40), (None, 7), ("z", 1))], ignore_index=True)
    pdf["y"] = 2 * pdf.a - pdf.b + rng.normal(size=len(pdf))
    name = pdf.series.where(pdf.series.notna(), None)
    spot = [f"{s}|{t:%Y-%m-%d %H:%M:%S}" if s is not None else f"{t:%Y-%m-%d %H:%M:%S}" for s, t in zip(name, pdf.datetime)]
    pdf["spot"] = [hashlib.md5(s.encode()).hexdigest() for s in spot]
    order = pdf.assign(series=name.fillna("none")).sort_values(["series", "spot"])
    want = {}
    for c in ("a", "b"):
        swapped = order.assign(**{c: order.groupby("series")[c].transform(lambda v: np.roll(v.to_numpy(), -1))})
        rmse = [np.sqrt(np.mean((d.y - (2 * d.a - d.b)) ** 2)) for d in (swapped, order)]
        want[c] = rmse[0] - rmse[1]
    monkeypatch.setattr(explain, "BUCKET_ROWS", bucket_rows)
    got = explain.permutation_importance(to_spark(spark, pdf.drop(columns="spot")), lambda d: d.withColumn("predicted", 2 * d["a"] - d["b"]),
                                         "y", ["a", "b"], ["series"]).collect()
    assert {r["feature"]: r["importance"] for r in got} == pytest.approx(want, abs=1e-9)

"""Boosted trees in segments, their attribution, storage, and forecasts with them."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F
from series_frames import to_spark

from gustline.operators import boosting, inference, registry, splits, trees
from gustline.operators.boosting import TRAIN, VAL, BoostedModel, BoostParams
from gustline.operators.windows import build_features
from gustline.sources import models as store
from gustline.spec import Contract, FeatureSpec, LinearModel

COLS = ["pm25_lag_1", "pm25_lag_24", "pm25_roll_mean_6", "temperature", "hour"]


@pytest.fixture(scope="module")
def table(spark, ar_series):
    return build_features(to_spark(spark, ar_series), FeatureSpec(), ["series"]).cache()


def noisy(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = 3 * np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c", "d"]).assign(y=y, id=range(n))
    role = np.where(np.arange(n) % 4 == 0, VAL, TRAIN)
    return pdf, role, spark.createDataFrame(pdf.assign(role=role)).withColumn("roles", F.array(F.col("role").cast("tinyint")))


def test_best_iteration_has_patience():
    losses = [5, 4, 3, 3.5, 3.4, 2.9, 3, 3, 3, 1]
    assert boosting.best_iteration(losses, patience=3) == 6
    assert boosting.best_iteration(losses, patience=50) == 10
    assert boosting.best_iteration([1, 2, 3], patience=1) == 1


@pytest.mark.parametrize("store_every", [1, 10])
def test_leaf_values_are_those_of_trees_fitted_one_by_one(spark, monkeypatch, store_every):
    """Replay of every tree on all rows: value of each leaf, rows in it, and the loss after it."""
    monkeypatch.setattr(boosting, "STORE_EVERY", store_every)
    pdf, role, rows = noisy(spark)
    params = BoostParams(step=0.1, subsample=1.0, patience=15, segment=10, trees=60, min_child=5, l1=1.0, l2=2.0)
    model = boosting.fit_boosted(rows.repartition(5), "y", [["a", "b", "c", "d"]], params)[0]
    x, y, train = pdf[["a", "b", "c", "d"]].to_numpy(), pdf["y"].to_numpy(), role == TRAIN
    assert model.base == pytest.approx(y[train].mean()) and len(model.losses) >= len(model.value) >= 30
    left, leaves = y - model.base, model.leaves_of(x)
    for t in range(len(model.value)):
        for leaf in range(4):
            mine = train & (leaves[:, t] == leaf)
            g = left[mine].sum()
            want = 0.1 * np.sign(g) * max(abs(g) - 1, 0) / (mine.sum() + 2) if mine.any() else 0
            assert model.value[t, leaf] == pytest.approx(want, abs=1e-9) and model.cover[t, leaf] == mine.sum()
            assert not mine.any() or mine.sum() >= 5
        left = left - model.value[t][leaves[:, t]]
        assert model.losses[t] == pytest.approx((left[~train] ** 2).mean())
    np.testing.assert_allclose(model.predict(x), y - left)
    assert (left[~train] ** 2).mean() < 0.4 * y[~train].var()


def test_several_fits_share_rows_and_limits_hold(spark):
    pdf, _, rows = noisy(spark)
    roles = F.array(*[F.when(F.col("id") % m == 0, VAL).when(F.col("id") % 7 != m, TRAIN).otherwise(0).cast("tinyint") for m in (4, 5)], F.lit(0).cast("tinyint"))
    params = BoostParams(step=0.2, depth=3, leaves=7, patience=10, segment=10, trees=80, min_child=5, gamma=0.0)
    cols = [["a", "b", "c", "d"], ["b", "a"], ["a"]]
    both = boosting.fit_boosted(rows.withColumn("roles", roles), "y", cols, params)
    assert [m.features for m in both] == cols
    for m in both[:2]:
        assert 0 < len(m.value) <= len(m.losses) <= 80 and ((m.cover > 0).sum(axis=1) <= 7).all() and m.feature.max() < len(m.features)
        assert len(m.losses) - len(m.value) >= 10 or len(m.losses) == 80
    assert len(both[2].value) == 0 and both[2].losses == []         # no training rows
    alone = boosting.fit_boosted(rows.withColumn("roles", F.slice(roles, 1, 1)), "y", [cols[0]], params)[0]
    assert len(alone.value) > 0 and alone.losses[0] == pytest.approx(both[0].losses[0], rel=0.05)
    assert both[0].importances().sum() == pytest.approx(1.0) and both[0].importances().argmax() == 0


def test_rows_without_a_column_are_scored_with_null(spark):
    _, _, rows = noisy(spark, 300)
    holes = rows.withColumn("a", F.when(F.col("id") % 5 != 0, F.col("a")).when(F.col("id") % 10 == 0, F.lit(float("nan"))))
    model = boosting.fit_boosted(holes, "y", [["a", "b"]], BoostParams(step=0.3, trees=10, segment=10, min_child=5))[0]
    scored = boosting.score_boosted(holes, model)
    assert scored.columns == [*rows.columns, "predicted"]
    assert {(r.id % 5 == 0) for r in scored.where("predicted is null").collect()} == {True}
    assert scored.where("predicted is null").count() == 60
    assert boosting.score_boosted(holes.where("false"), model).count() == 0


def test_boosted_trees_learn(table):
    params = BoostParams(step=0.2, trees=120, patience=20, segment=20)
    model = trees.fit_boosted_final(table, "pm25", COLS, ["series"], params)
    assert len(model.losses) - len(model.value) >= 20 or len(model.losses) == 120
    got = {r["role"]: r["r2"] for r in trees.final_metrics(model, table, "pm25", ["series"]).collect()}
    assert got["dev"] > 0.5
    imp = trees.importance_table(model, model.features, table.sparkSession).toPandas()
    assert imp["importance"].sum() == pytest.approx(1.0)
    with pytest.raises(ValueError):
        trees.importance_table(model, COLS[:2], table.sparkSession)


def test_fold_roles_are_those_of_the_folds(table):
    dev = splits.development(table, ["series"])
    want = {(r.series, r.datetime, r.fold): r.role for r in splits.ts_folds(dev, ["series"]).collect()}
    got = {(r.series, r.datetime, i): {1: "train", 2: "val"}[x] for r in splits.fold_roles(dev, ["series"]).collect() for i, x in enumerate(r.roles, 1) if x}
    assert got == want


def test_boosted_cv(table):
    folds, models = trees.boosted_cv(table, "pm25", COLS, ["series"], BoostParams(step=0.2, trees=40, segment=20), by=["series"], final=True)
    rows = folds.collect()
    assert {(r["series"], r["fold"]) for r in rows} == {(s, f) for s in "ab" for f in (1, 2, 3)} and len(models) == 4
    assert all(r["ratio"] == pytest.approx(r["val_rmse"] / r["train_rmse"], abs=2e-3) for r in rows)


# -- attribution ------------------------------------------------------------------------------
def shapley_by_hand(model: BoostedModel, x):
    """Over all subsets of all columns; a column outside is averaged over by the rows that went each way."""
    n, inner = len(model.features), model.feature.shape[1]
    weight = [model.cover]
    while weight[0].shape[1] > 1:
        weight.insert(0, weight[0].reshape(len(model.cover), -1, 2).sum(axis=2))
    weight = np.concatenate(weight, axis=1)

    def value(t, node, known):
        if node >= inner:
            return model.value[t, node - inner]
        f, cut = model.feature[t, node], model.threshold[t, node]
        if f in known or np.isinf(cut):
            return value(t, 2 * node + 1 + (x[f] > cut), known)
        a, b = weight[t, 2 * node + 1], weight[t, 2 * node + 2]
        return (a * value(t, 2 * node + 1, known) + b * value(t, 2 * node + 2, known)) / (a + b)

    game = {s: model.base + sum(value(t, 0, set(s)) for t in range(len(model.value)))
            for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    phi = np.zeros(n)
    for i in range(n):
        for s in game:
            if i not in s:
                share = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                phi[i] += share * (game[tuple(sorted((*s, i)))] - game[s])
    return phi, game[()]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_attributions_equal_all_subsets(spark, depth):
    pdf, _, rows = noisy(spark, 400)
    params = BoostParams(step=0.3, depth=depth, trees=12, segment=12, min_child=10, l1=0.0, l2=1.0, colsample=0.9)
    model = boosting.fit_boosted(rows, "y", [["a", "b", "c", "d"]], params)[0]
    some = boosting.tree_attributions(rows.where("id < 25"), model).collect()
    for r in some:
        x = np.array([r.a, r.b, r.c, r.d])
        phi, mean = shapley_by_hand(model, x)
        np.testing.assert_allclose(r.attributions, phi, atol=1e-9)
        assert sum(r.attributions) == pytest.approx(model.predict(x[None, :])[0] - mean)
    assert boosting.expected_value(model) == pytest.approx(mean)
    means = {r.feature: r.mean_abs_shap for r in boosting.tree_attribution(rows.where("id < 25"), model).collect()}
    assert means == pytest.approx({c: np.mean([abs(r.attributions[i]) for r in some]) for i, c in enumerate("abcd")})


# -- node tables, stored models, forecasts --------------------------------------------------------
@pytest.fixture(scope="module")
def fitted(spark, table):
    known = ["pm25_lag_1", "pm25_lag_24", "pm25_roll_mean_6", "temperature", "hour"]
    ensemble = trees.fit_boosted_final(table, "pm25", known, ["series"], BoostParams(step=0.3, trees=40, segment=20))
    forest = trees.fit_forest(table, "pm25", known, numTrees=7, maxDepth=3)
    return known, ensemble, forest


def test_node_table_round_trip(spark, fitted):
    _, ensemble, _ = fitted
    back = boosting.from_nodes(boosting.node_table(spark, ensemble).repartition(5))
    assert back.features == ensemble.features and back.base == ensemble.base
    for name in ("feature", "threshold", "value", "cover"):
        np.testing.assert_array_equal(getattr(back, name), getattr(ensemble, name))


def past_and_future(table, n):
    history = table.where(F.col("datetime") < "2024-01-20").select("series", "datetime", "pm25")
    future = table.where(F.col("datetime") >= "2024-01-20").select("series", "datetime", "temperature")
    order = F.row_number().over(Window.partitionBy("series").orderBy("datetime"))
    return history, future.withColumn("step", order).where(F.col("step") <= n)


def test_forecast_in_one_pass_equals_steps(table, fitted):
    known, ensemble, _ = fitted
    history, future = past_and_future(table, 24)
    steps = inference.forecast_with_model(history, future, lambda d: boosting.score_boosted(d, ensemble), ensemble.features, ["series"], horizon=24)
    once = inference.forecast_trees(history, future, ensemble, ["series"])
    want = {(r.series, r.hour): (r.datetime, r.predicted_pm25, r.category) for r in steps.collect()}
    got = {(r.series, r.hour): (r.datetime, r.predicted_pm25, r.category) for r in once.collect()}
    assert len(want) == 48 and got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=0.0101)
    with pytest.raises(ValueError, match="lag"):
        inference.forecast_trees(history, future, BoostedModel(["pm25_lag_2"], 0.0), ["series"])


def artefacts(spark, fitted, names):
    known, ensemble, forest = fitted
    contract = spark.createDataFrame([(s, m, known if m != "boosted" else ensemble.features) for s, m in names], "series string, model_name string, features array<string>")
    linear = spark.createDataFrame([("b", "ridge", known, [0.5, 0.2, 0.1, 0.3, -0.1], 4.0)],
                                   "series string, model string, features array<string>, slopes array<double>, bias double")
    return store.Artefacts(contract, linear, {"boosted": ensemble}, {"random_forest": forest})


def test_saved_models_score_as_fitted(spark, table, fitted, tmp_path):
    known, ensemble, forest = fitted
    root = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        store.load_models(spark, root)
    store.save_models(spark, root, artefacts(spark, fitted, [("a", "random_forest"), ("b", "ridge")]))
    back = store.load_models(spark, root)
    got = {(r.series, r.datetime): r for r in inference.score_promoted(table, back, ["series"]).collect()}
    a = {(r.series, r.datetime): r.predicted for r in forest.transform(table.where("series = 'a'")).collect()}
    b = {(r.series, r.datetime): 4 + .5 * r.pm25_lag_1 + .2 * r.pm25_lag_24 + .1 * r.pm25_roll_mean_6 + .3 * r.temperature - .1 * r.hour
         for r in table.where("series = 'b'").collect()}
    assert {k: r.predicted for k, r in got.items()} == pytest.approx({**a, **b})
    assert {(k[0], r.model_name) for k, r in got.items()} == {("a", "random_forest"), ("b", "ridge")}
    arrays = {(r.series, r.datetime): r.predicted for r in boosting.score_boosted(table.where("series = 'a'"), back.ensembles["random_forest"]).collect()}
    assert arrays == pytest.approx(a)

    history, future = past_and_future(table, 10)
    ahead = {(r.series, r.hour): r.predicted_pm25 for r in inference.forecast_promoted(history, future, back, ["series"]).collect()}
    by_steps = inference.forecast_with_model(history, future, lambda d: forest.transform(d).drop("features"), known, ["series"], horizon=10)
    linear = LinearModel(Contract("ridge", known), [0.5, 0.2, 0.1, 0.3, -0.1], 4.0)
    want = {(r.series, r.hour): r.predicted_pm25 for s, f in (("a", by_steps), ("b", inference.forecast_linear(history, future, linear, ["series"])))
            for r in f.where(F.col("series") == s).collect()}
    assert ahead == pytest.approx(want, abs=0.0101) and len(want) == 20


def test_a_failed_save_leaves_the_promoted_models(spark, table, fitted, tmp_path):
    root = str(tmp_path / "models")
    store.save_models(spark, root, artefacts(spark, fitted, [("a", "boosted")]))
    before = store.current_version(spark, root)
    broken = artefacts(spark, fitted, [("a", "ridge")])
    broken.linear = broken.linear.withColumn("bias", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(PySparkException):
        store.save_models(spark, root, broken)
    back = store.load_models(spark, root)
    assert store.current_version(spark, root) == before and list(back.ensembles) == ["boosted"]
    store.save_models(spark, root, artefacts(spark, fitted, [("b", "ridge")]))
    assert store.current_version(spark, root) != before and store.load_models(spark, root).ensembles == {}
    missing = artefacts(spark, fitted, [("a", "unknown")])
    store.save_models(spark, root, missing)
    with pytest.raises(FileNotFoundError, match="unknown"):
        store.load_models(spark, root)


def test_contract_of_a_promoted_ensemble(spark):
    board = spark.createDataFrame([("boosted", 1.0, 2.0, 0.9, 0.01, 0.8, 0.02), ("lasso", 0.5, 1.0, 0.95, 0.01, None, None)],
                                  "model string, mae double, rmse double, r2 double, r2_gap double, cv_val_r2 double, cv_gap double")
    best = registry.select_best(board)
    row = registry.promote(best, spark.createDataFrame([("boosted", ["x"])], "model string, features array<string>")).first()
    assert row["model_name"] == "boosted" and row["features"] == ["x"] and row["n_features"] == 1     # lasso has no gap and never competes

"""Queries over selection, training, comparison, scoring, forecasts and attribution."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions.bands import feature_family, gap_verdict
from gustline.operators import boosting, explain, inference, linear, metrics, registry, selection, summary, trees
from gustline.operators.blocks import IDX, SIZE, with_row_index
from gustline.operators.feeds import future_horizon
from gustline.operators.splits import development, holdout, ts_folds
from gustline.plans.frames import (CUT, MODEL_FEATURES, SERIES, Query, add_cte, features, merged, sql,
                                   stored_existing, stored_features, weather)
from gustline.plans.summaries import band_case, family_case, verdict_case
from gustline.sources.models import Artefacts, load_models, save_models
from gustline.spec import Contract, LinearModel

# The models that are compared: a past value or mean as the prediction.
PREDICTORS = {"persistence": "pm25_lag_1", "daily": "pm25_lag_24",
              "rolling6": "pm25_roll_mean_6", "rolling24": "pm25_roll_mean_24"}
BY = [*SERIES, "model"]

SCORER = LinearModel(
    Contract("ridge", ["pm25_lag_1", "pm25_lag_24", "pm25_roll_mean_24", "temperature", "hour_sin"],
             requires_scaling=True),
    coefs=[4.0, 2.5, 3.0, -1.25, 0.5], intercept=50.0,
    means=[50.0, 50.0, 50.0, 48.0, 0.0], stds=[35.0, 35.0, 8.0, 20.0, 0.7])
FORECASTER = LinearModel(
    Contract("ridge", ["pm25_lag_1", "pm25_lag_24", "pm25_roll_mean_6", "pm25_roll_std_3", "temperature", "hour_sin"]),
    coefs=[0.4, 0.2, 0.25, 0.05, 0.02, 1.5], intercept=6.0)


def r(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- selection and training -----------------------------------------------------------------
def select_f_regression(spark: SparkSession, sf: str) -> DataFrame:
    out = selection.select_f_regression(features(spark, sf), "pm25", MODEL_FEATURES, k=6, by=SERIES)
    return r(out, 6, "f_score", "r").select(*SERIES, "feature", "n", "r", "f_score", "rank", "place")


def selected_names(spark: SparkSession, sf: str) -> DataFrame:
    picked = selection.select_f_regression(features(spark, sf), "pm25", MODEL_FEATURES, k=6, by=SERIES)
    names = selection.selected_names(picked, SERIES)
    return names.select(*SERIES, F.array_join("features", ",").alias("features"), F.size("features").alias("n_features"))


def select_tree(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_tree(features(spark, sf), "pm25", MODEL_FEATURES)


def standardise_fit_train(spark: SparkSession, sf: str) -> DataFrame:
    rows = holdout(stored_features(spark, sf), SERIES)
    cols = ["temperature", "humidity", "pm25_lag_1"]
    stats = selection.scaler_stats(rows.where(F.col("role") == "dev"), cols, SERIES)
    return r(selection.standardise(rows, stats, cols, SERIES).select(*SERIES, "datetime", "role", *cols), 6, *cols)


def ridge_2feature(spark: SparkSession, sf: str) -> DataFrame:
    out = linear.ridge_two(features(spark, sf), "pm25", ["pm25_lag_1", "temperature"], 10.0, SERIES)
    return r(out, 6, "intercept", "coef_pm25_lag_1", "coef_temperature")


def coef_ranking(spark: SparkSession, sf: str) -> DataFrame:
    names = ["pm25_lag_1", "temperature"]
    two = linear.ridge_two(features(spark, sf), "pm25", names, 10.0, SERIES)
    models = two.select(*SERIES, F.array(*[F.lit(n) for n in names]).alias("features"),
                        F.array(*[F.round(f"coef_{n}", 6) for n in names]).alias("coefs"))
    return linear.coef_ranking(models, SERIES)


def importance_table(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute coefficients as importances with share and family, most important first."""
    two = linear.ridge_two(features(spark, sf), "pm25", ["pm25_lag_1", "temperature"], 10.0, SERIES)
    names = ["pm25_lag_1", "temperature"]
    imp = two.select(*SERIES, *[F.abs(f"coef_{n}").alias(n) for n in names]) \
        .unpivot(SERIES, names, "feature", "importance").withColumn("importance", F.round("importance", 6))
    shares = summary.importance_share(imp, SERIES).withColumn("source", F.lit("model"))
    return r(shares, 6, "pct", "cumulative")


def ridge_cv(spark: SparkSession, sf: str) -> DataFrame:
    out = linear.ridge_cv(stored_features(spark, sf), "pm25", MODEL_FEATURES, SERIES)
    return out.select(*SERIES, "fold", "alpha", "n_train", "n_val", "train_rmse", "val_rmse", "train_r2",
                      "val_r2", "ratio", F.array_join("features", ",").alias("features"))


def ridge_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Final ridge per series: MAE, RMSE and R² on development and test rows."""
    from gustline.session import materialise
    table = stored_features(spark, sf)
    models = materialise(linear.ridge_cv(table, "pm25", MODEL_FEATURES, SERIES).where(F.col("fold") == 0), "ridge")
    scored = linear.score_models(holdout(table, SERIES), models, MODEL_FEATURES, SERIES)
    return metrics.regression_metrics(scored, "pm25", "predicted", [*SERIES, "role"])


def lasso_cv(spark: SparkSession, sf: str) -> DataFrame:
    out = linear.lasso_cv(stored_features(spark, sf), "pm25", MODEL_FEATURES, SERIES)
    return linear.coef_ranking(out, [*SERIES, "alpha", "train_r2", "val_r2"], nonzero=True)


def random_forest(spark: SparkSession, sf: str) -> DataFrame:
    table = stored_features(spark, sf)
    cols = [row["feature"] for row in selection.select_tree(development(table, SERIES), "pm25", MODEL_FEATURES,
                                                            trees.TREE_FEATURES).collect()]
    model = trees.fit_forest(development(table, SERIES), "pm25", cols)
    return trees.final_metrics(model, table, "pm25", SERIES)


def _boosted(spark: SparkSession, sf: str, params: boosting.BoostParams) -> DataFrame:
    """Selected features, stopping by patience, final fit; the gap of R² with its verdict on both rows."""
    table = stored_features(spark, sf)
    model = trees.fit_boosted_final(table, "pm25", MODEL_FEATURES, SERIES, params)
    out = trees.final_metrics(model, table, "pm25", SERIES)
    gap = out.agg((F.max(F.when(F.col("role") == "dev", F.col("r2"))) - F.max(F.when(F.col("role") == "test", F.col("r2"))))
                  .alias("r2_gap"))
    return out.join(F.broadcast(gap)).withColumns({     # one row
        "r2_gap": F.round("r2_gap", 4), "verdict": gap_verdict("r2_gap"), "best_iteration": F.lit(len(model.value)),
        "trees_fitted": F.lit(len(model.losses)), "features": F.lit(",".join(model.features))})


def boosted_trees_a(spark: SparkSession, sf: str) -> DataFrame:
    return _boosted(spark, sf, boosting.BOOST_A)


def boosted_trees_b(spark: SparkSession, sf: str) -> DataFrame:
    return _boosted(spark, sf, boosting.BOOST_B)


def _with_gap(folds: DataFrame) -> DataFrame:
    """Fold rows with the gap of R² and its verdict."""
    return folds.withColumn("r2_gap", F.round(F.col("train_r2") - F.col("val_r2"), 4)).withColumn("verdict", gap_verdict("r2_gap"))


def forest_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Features are selected anew in every fold."""
    return _with_gap(trees.tree_cv(stored_features(spark, sf), "pm25", MODEL_FEATURES, SERIES,
                                   lambda train, val, cols: trees.fit_forest(train, "pm25", cols)))


def _boosted_cv(spark: SparkSession, sf: str, params: boosting.BoostParams) -> DataFrame:
    """The folds with the number of trees each stopped at; features are selected anew in every fold."""
    folds, models = trees.boosted_cv(stored_features(spark, sf), "pm25", MODEL_FEATURES, SERIES, params)
    best = spark.createDataFrame([(i, len(m.value)) for i, m in enumerate(models, 1)], "fold int, best_iteration int")
    return _with_gap(folds.join(F.broadcast(best), "fold"))     # one row per fold


def boosted_cv_a(spark: SparkSession, sf: str) -> DataFrame:
    return _boosted_cv(spark, sf, boosting.BOOST_A)


def boosted_cv_b(spark: SparkSession, sf: str) -> DataFrame:
    return _boosted_cv(spark, sf, boosting.BOOST_B)


# -- comparison -----------------------------------------------------------------------------
def _predictions(rows: DataFrame) -> DataFrame:
    """One row per (row, model): the models are columns of the feature table."""
    ids = [c for c in rows.columns if c not in MODEL_FEATURES and c not in ("n", "pm25")]
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("predicted")) for m, c in PREDICTORS.items()])
    return rows.select(*ids, "pm25", F.inline(pairs))


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predictions(holdout(stored_features(spark, sf), SERIES))
    return metrics.regression_metrics(rows, "pm25", "predicted", [*BY, "role"])


def _cv(table: DataFrame) -> DataFrame:
    folds = _predictions(ts_folds(development(table, SERIES), SERIES))
    return metrics.cv_rollup(metrics.fold_metrics(folds, "pm25", "predicted", BY), BY)


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    folds = _predictions(ts_folds(development(stored_features(spark, sf), SERIES), SERIES))
    return metrics.fold_metrics(folds, "pm25", "predicted", BY)


def cv_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _cv(stored_features(spark, sf))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    table = stored_features(spark, sf)
    sides = metrics.regression_metrics(_predictions(holdout(table, SERIES)), "pm25", "predicted", [*BY, "role"])
    return metrics.metrics_record(_cv(table), sides, BY)


def metrics_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.leaderboard_rows(_records(spark, sf), BY)


def model_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return registry.leaderboard(metrics.leaderboard_rows(_records(spark, sf), BY), SERIES)


def select_best_model(spark: SparkSession, sf: str) -> DataFrame:
    return registry.select_best(metrics.leaderboard_rows(_records(spark, sf), BY), SERIES)


def select_best_min_gap(spark: SparkSession, sf: str) -> DataFrame:
    return registry.select_best(metrics.leaderboard_rows(_records(spark, sf), BY), SERIES, policy="min_gap")


def promote_contract(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    used = F.create_map(*[x for m, c in PREDICTORS.items() for x in (F.lit(m), F.array(F.lit(c)))])
    artefacts = records.select(*BY, used[F.col("model")].alias("features"))
    best = registry.select_best(metrics.leaderboard_rows(records, BY), SERIES)
    return registry.promote(best, artefacts, SERIES).select(
        *SERIES, "model_name", "target", "requires_scaling", F.array_join("features", ",").alias("features"),
        "n_features", "selected_by", "cv_val_r2", "cv_r2_gap", F.col("test_metrics.rmse").alias("test_rmse"),
        "test_r2_gap")


def _registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Weekly evaluations of each model as its versions; the last week is new."""
    rows = _predictions(features(spark, sf)).withColumn("week", F.to_date(F.date_trunc("week", "datetime")))
    weekly = metrics.regression_metrics(rows, "pm25", "predicted", ["model", "week"]).select("model", "week", "rmse", "r2")
    last = rows.agg(F.max("week").alias("_last"))
    marked = weekly.join(F.broadcast(last))     # one row
    old = marked.where(F.col("week") < F.col("_last")).drop("_last")
    new = marked.where(F.col("week") == F.col("_last")).drop("_last")
    empty = spark.createDataFrame([], "model string, week date, rmse double, r2 double, version int")
    return registry.registry_append(empty, old), new


def registry_append(spark: SparkSession, sf: str) -> DataFrame:
    return registry.registry_append(*_registry(spark, sf))


def registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    return registry.registry_latest(registry.registry_append(*_registry(spark, sf)))


def registry_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.registry_metrics(select_best_model(spark, sf), BY)


# -- inference ------------------------------------------------------------------------------
def score_linear(spark: SparkSession, sf: str) -> DataFrame:
    out = inference.score_linear(features(spark, sf), SCORER)
    return r(out.select(*SERIES, "datetime", "predicted"), 6, "predicted")


def backtest_72(spark: SparkSession, sf: str) -> DataFrame:
    return inference.backtest(stored_features(spark, sf), SCORER, SERIES, digits=6)


def backtest_mae(spark: SparkSession, sf: str) -> DataFrame:
    rows = inference.backtest(stored_features(spark, sf), SCORER, SERIES, digits=6)
    return rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.round(F.avg(F.abs(F.col("actual_pm25") - F.col("predicted_pm25"))), 4).alias("mae"))


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    history = stored_existing(spark, sf)
    future = future_horizon(weather(spark, sf), history, SERIES)
    return inference.forecast_linear(history, future, FORECASTER, SERIES)


def recursive_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(spark, sf).withColumn("hour", F.col("hour").cast("int"))


def forecast_with_trees(spark: SparkSession, sf: str) -> DataFrame:
    """The whole horizon with a forest that was fitted on the rows before the forecast only, from its saved trees in one pass."""
    from gustline.session import shared_dir
    cols = ["pm25_lag_1", "pm25_lag_24", "pm25_roll_mean_6", "temperature", "hour_sin"]
    model = trees.fit_forest(features(spark, sf).where(F.col("datetime") < F.lit(CUT).cast("timestamp_ntz")), "pm25", cols)
    folder = shared_dir(spark, "forest")
    model.stages[-1].write().save(folder)
    history = stored_existing(spark, sf)
    future = future_horizon(weather(spark, sf), history, SERIES)
    return inference.forecast_trees(history, future, trees.forest_ensemble(spark, folder, cols), SERIES)


def forecast_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """The whole horizon in one pass with boosted trees that saw the rows before the forecast only."""
    before = stored_features(spark, sf).where(F.col("datetime") < F.lit(CUT).cast("timestamp_ntz"))
    model = trees.fit_boosted_final(before, "pm25", KNOWN_AHEAD, SERIES, CHAIN_BOOST["boosted_a"])
    history = stored_existing(spark, sf)
    return inference.forecast_trees(history, future_horizon(weather(spark, sf), history, SERIES), model, SERIES)


def forecast_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r(summary.forecast_summary(_forecast(spark, sf), SERIES), 6, "mean_value")


# -- the chain from training to forecasts ------------------------------------------------------
# Only what is known, or can be derived, for hours ahead.
KNOWN_AHEAD = [c for c in MODEL_FEATURES if c not in ("pm10", "co")]
# The chain trains every kind of model in one query: larger steps and a smaller forest than in the queries of their own.
CHAIN_BOOST = {"boosted_a": replace(boosting.BOOST_A, step=0.1), "boosted_b": replace(boosting.BOOST_B, step=0.1)}
CHAIN_FOREST = {"numTrees": 100}


def _trained(spark: SparkSession, table: DataFrame) -> tuple[DataFrame, Artefacts]:
    """Records of ridge, lasso, forest and both boosted models per series, and the fitted models (their contract is not made yet)."""
    from gustline.session import materialise
    held = holdout(table, SERIES)
    ridge = materialise(linear.ridge_cv(table, "pm25", KNOWN_AHEAD, SERIES), "ridge")
    lasso = materialise(linear.lasso_cv(table, "pm25", KNOWN_AHEAD, SERIES), "lasso")
    fold_names = ["fold", "train_rmse", "val_rmse", "train_r2", "val_r2", "ratio"]
    folds = ridge.where("fold > 0").select(*SERIES, F.lit("ridge").alias("model"), *fold_names)
    finals = {"ridge": linear.score_models(held, ridge.where("fold = 0"), KNOWN_AHEAD, SERIES),
              "lasso": linear.score_models(held, lasso, KNOWN_AHEAD, SERIES)}

    dev = development(table, SERIES)
    cols = [row["feature"] for row in selection.select_tree(dev, "pm25", KNOWN_AHEAD, trees.TREE_FEATURES).collect()]
    forest = trees.fit_forest(dev, "pm25", cols, **CHAIN_FOREST)
    finals["random_forest"] = forest.transform(held).drop("features")
    forest_folds = trees.tree_cv(table, "pm25", KNOWN_AHEAD, SERIES,
                                 lambda train, val, some: trees.fit_forest(train, "pm25", some, **CHAIN_FOREST), by=SERIES)
    folds = folds.unionByName(forest_folds.select(*SERIES, F.lit("random_forest").alias("model"), *fold_names))
    ensembles = {}
    for name, params in CHAIN_BOOST.items():
        found, models = trees.boosted_cv(table, "pm25", KNOWN_AHEAD, SERIES, params, by=SERIES, final=True)
        ensembles[name] = models[-1]
        finals[name] = boosting.score_boosted(held, models[-1])
        folds = folds.unionByName(found.select(*SERIES, F.lit(name).alias("model"), *fold_names))

    scored = None
    for name, rows in finals.items():
        part = rows.select(*SERIES, "role", "pm25", "predicted", F.lit(name).alias("model"))
        scored = part if scored is None else scored.unionByName(part)
    sides = metrics.regression_metrics(scored, "pm25", "predicted", [*BY, "role"])
    records = materialise(metrics.metrics_record(metrics.cv_rollup(folds, BY), sides, BY), "records")

    lines = [m.select(*SERIES, F.lit(name).alias("model"), F.array(*[F.lit(c) for c in KNOWN_AHEAD]).alias("features"), "slopes", "bias")
             for name, m in (("ridge", ridge.where("fold = 0")), ("lasso", lasso))]
    return records, Artefacts(records, lines[0].unionByName(lines[1]), ensembles, {"random_forest": forest})


def _promoted(spark: SparkSession, table: DataFrame) -> Artefacts:
    """Train, compare, choose, save, and read back what was saved."""
    from gustline.session import shared_dir
    records, fitted = _trained(spark, table)
    shared = spark.createDataFrame(
        [(m, e.features) for m, e in fitted.ensembles.items()]
        + [(m, p.stages[0].getInputCols()) for m, p in fitted.pipelines.items()], "model string, features array<string>")
    own = fitted.linear.select(*BY, "features")
    used = records.select(*BY).join(F.broadcast(shared), "model").select(*BY, "features").unionByName(own)     # one row per kind of model
    best = registry.select_best(metrics.leaderboard_rows(records, BY), SERIES)
    contract = registry.promote(best, used, SERIES, scaled_models=())       # slopes are those of unscaled columns
    root = shared_dir(spark, "promoted")
    save_models(spark, root, replace(fitted, contract=contract))
    return load_models(spark, root)


def trained_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds of models of every series, best first."""
    records, _ = _trained(spark, stored_features(spark, sf))
    return registry.leaderboard(metrics.leaderboard_rows(records, BY), SERIES)


def promoted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Holdout rows scored by the promoted model of their series, as saved and loaded again."""
    table = stored_features(spark, sf)
    promoted = _promoted(spark, table)
    out = inference.score_promoted(holdout(table, SERIES).where(F.col("role") == "test"), promoted, SERIES)
    return r(out.select(*SERIES, "datetime", "model_name", "pm25", "predicted"), 6, "predicted")


def promoted_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The next hours of every series with its promoted model, fitted on rows before the forecast only."""
    table = stored_features(spark, sf)
    promoted = _promoted(spark, table.where(F.col("datetime") < F.lit(CUT).cast("timestamp_ntz")))
    history = stored_existing(spark, sf)
    future = future_horizon(weather(spark, sf), history, SERIES)
    return inference.forecast_promoted(history, future, promoted, SERIES)


# -- attribution ----------------------------------------------------------------------------
def linear_shap(spark: SparkSession, sf: str) -> DataFrame:
    return r(explain.linear_attribution(stored_features(spark, sf), SCORER, SERIES), 6, "mean_abs_shap")


def tree_shap(spark: SparkSession, sf: str) -> DataFrame:
    """Exact Shapley values of boosted trees over all complete rows, averaged per series and feature."""
    table = stored_features(spark, sf)
    model = trees.fit_boosted_final(table, "pm25", MODEL_FEATURES, SERIES, CHAIN_BOOST["boosted_a"])
    return r(boosting.tree_attribution(table, model, SERIES), 6, "mean_abs_shap").withColumn("family", feature_family("feature"))


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    names = SCORER.contract.features
    sample = explain.attribution_sample(stored_features(spark, sf), names, SERIES)
    out = explain.permutation_importance(sample, lambda d: inference.score_linear(d, SCORER), "pm25", names, SERIES)
    return r(out.withColumn("family", feature_family("feature")), 6, "importance")


# -- SQL ------------------------------------------------------------------------------------
add_cte("scores", ["features"], f"""SELECT *, row_number() OVER (PARTITION BY series ORDER BY f_score DESC NULLS LAST, position DESC) AS rank
    FROM (SELECT *, r * r / (1 - r * r) * (n - 2) AS f_score FROM ({' UNION ALL '.join(
        f"SELECT series, '{c}' AS feature, {i} AS position, count(*) AS n, "
        f"CASE WHEN isnan(corr({c}, pm25)) THEN NULL ELSE corr({c}, pm25) END AS r FROM features GROUP BY series"
        for i, c in enumerate(MODEL_FEATURES))}))""")
add_cte("picked", ["scores"], """SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY rank > 6,
    CASE WHEN rank <= 6 THEN position ELSE list_position(['pm25_lag_1', 'pm25_lag_24', 'pm25_roll_mean_24'], feature) END) AS INTEGER) AS place
    FROM scores WHERE rank <= 6 OR feature IN ('pm25_lag_1', 'pm25_lag_24', 'pm25_roll_mean_24')""")
add_cte("two", ["features"], """SELECT series, n, intercept,
    ((n + 10.0) * ya - n * rab * yb) / ((n + 10.0) * (n + 10.0) - n * rab * n * rab) AS c1,
    ((n + 10.0) * yb - n * rab * ya) / ((n + 10.0) * (n + 10.0) - n * rab * n * rab) AS c2
    FROM (SELECT series, count(*) AS n, corr(pm25_lag_1, temperature) AS rab, avg(pm25) AS intercept,
    count(*) * covar_pop(pm25_lag_1, pm25) / stddev_pop(pm25_lag_1) AS ya,
    count(*) * covar_pop(temperature, pm25) / stddev_pop(temperature) AS yb FROM features GROUP BY 1)""")


def _long(source: str) -> str:
    return " UNION ALL ".join(f"SELECT *, '{m}' AS model, {c} AS predicted FROM {source}" for m, c in PREDICTORS.items())


_M = """round(avg(abs(pm25 - predicted)), 4) AS mae, round(sqrt(avg((pm25 - predicted) * (pm25 - predicted))), 4) AS rmse,
    round(1 - sum((pm25 - predicted) * (pm25 - predicted)) / (var_pop(pm25) * count(*)), 4) + 0.0 AS r2"""
add_cte("roles", ["held"], "SELECT *, CASE WHEN idx > size - test_size THEN 'test' ELSE 'dev' END AS role FROM held")
add_cte("sides", ["roles"], f"SELECT series, model, role, count(*) AS n, {_M} FROM ({_long('roles')}) GROUP BY 1, 2, 3")
add_cte("fold_rows", ["folds"], f"""SELECT series, model, fold, round(max(rmse) FILTER (WHERE role = 'train'), 4) AS train_rmse,
    round(max(rmse) FILTER (WHERE role = 'val'), 4) AS val_rmse, round(max(r2) FILTER (WHERE role = 'train'), 4) + 0.0 AS train_r2,
    round(max(r2) FILTER (WHERE role = 'val'), 4) + 0.0 AS val_r2,
    round(max(rmse) FILTER (WHERE role = 'val') / max(rmse) FILTER (WHERE role = 'train'), 4) AS ratio
    FROM (SELECT series, model, fold, role, sqrt(avg((pm25 - predicted) * (pm25 - predicted))) AS rmse,
    1 - sum((pm25 - predicted) * (pm25 - predicted)) / (var_pop(pm25) * count(*)) AS r2
    FROM ({_long('folds')}) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
add_cte("cvs", ["fold_rows"], f"""SELECT series, model, round(avg(train_r2), 4) + 0.0 AS mean_train_r2,
    round(avg(val_r2), 4) + 0.0 AS mean_val_r2, round(avg(train_r2) - avg(val_r2), 4) + 0.0 AS r2_gap,
    {verdict_case('(avg(train_r2) - avg(val_r2))')} AS verdict, round(median(ratio), 4) AS rmse_ratio_median,
    count(*) AS n_splits FROM fold_rows GROUP BY 1, 2""")
add_cte("board", ["sides", "cvs"], """SELECT t.series, t.model, t.mae, t.rmse, t.r2, round(d.r2 - t.r2, 4) + 0.0 AS r2_gap,
    c.mean_val_r2 AS cv_val_r2, c.r2_gap AS cv_gap FROM sides t JOIN sides d USING (series, model)
    JOIN cvs c USING (series, model) WHERE t.role = 'test' AND d.role = 'dev'""")


def _best(order: str, label: str) -> str:
    return f"""SELECT * EXCLUDE (healthy, any_ok), '{label}' AS selected_by FROM
        (SELECT *, cv_gap <= 0.05 AS healthy, bool_or(cv_gap <= 0.05) OVER (PARTITION BY series) AS any_ok FROM board)
        WHERE healthy OR NOT any_ok
        QUALIFY row_number() OVER (PARTITION BY series ORDER BY {order}, model) = 1"""


add_cte("best", ["board"], _best("rmse, cv_val_r2 DESC", "min_rmse_then_cv_val_r2_among_healthy"))
add_cte("entries", ["features"], f"""SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY week) AS INTEGER) AS version
    FROM (SELECT model, week, rmse, r2 FROM (SELECT model, CAST(date_trunc('week', datetime) AS DATE) AS week, {_M}
    FROM ({_long('features')}) GROUP BY 1, 2))""")

_SCORE = " + ".join(["50.0"] + [
    f"({c}) * (({f} - ({m})) / {s})" for f, c, m, s in
    zip(SCORER.contract.features, SCORER.coefs, SCORER.means, SCORER.stds)])
_RMSE = "sqrt(avg((pm25 - ({0})) * (pm25 - ({0}))))"


def _swapped(k: int) -> str:
    """The score with feature k taken from the other row."""
    return " + ".join(["50.0"] + [
        f"({c}) * (({f'other_{i}' if i == k else f} - ({m})) / {s})" for i, (f, c, m, s) in enumerate(
            zip(SCORER.contract.features, SCORER.coefs, SCORER.means, SCORER.stds))])


add_cte("backtests", ["positions"], f"""SELECT series, datetime, round(pm25, 6) AS actual_pm25, round({_SCORE}, 6) AS predicted_pm25
    FROM positions WHERE idx > size - 72""")
_STEP = ("6.0 + 0.4 * h[len(h)] + 0.2 * h[len(h) - 23] + 0.25 * list_avg(h[len(h) - 5:]) "
         "+ 0.05 * list_stddev_samp(h[len(h) - 2:]) + 0.02 * f.temperature + 1.5 * sin(2 * pi() * hour(f.datetime) / 24)")
FORECAST_SQL = f"""WITH RECURSIVE past AS (SELECT series, list(pm25 ORDER BY datetime) AS h, max(datetime) AS last
      FROM existing GROUP BY 1),
    future AS (SELECT w.*, row_number() OVER (PARTITION BY w.series ORDER BY w.datetime) AS step
      FROM weather w JOIN past p USING (series) WHERE w.datetime > p.last),
    walk AS (SELECT series, CAST(0 AS BIGINT) AS step, h[len(h) - 23:] AS h, CAST(NULL AS TIMESTAMP) AS datetime,
        CAST(NULL AS DOUBLE) AS yhat FROM past
      UNION ALL
      SELECT series, step, list_append(h, y)[2:], datetime, y FROM
        (SELECT k.series, f.step, k.h, f.datetime, {_STEP} AS y FROM walk k JOIN future f
         ON f.series = k.series AND f.step = k.step + 1 WHERE k.step < 72)),
    forecast AS (SELECT series, CAST(step AS INTEGER) AS hour, datetime, round(yhat, 2) AS predicted_pm25,
        {band_case('yhat')} AS category, {band_case('yhat', 3)} AS status FROM walk WHERE step > 0)
    """


def _forecast_sql(body: str) -> str:
    head = sql("existing weather", "")
    return "WITH RECURSIVE " + head[len("WITH "):].rstrip() + ",\n" + FORECAST_SQL[len("WITH RECURSIVE "):] + body


_TWO_LONG = """SELECT series, 'pm25_lag_1' AS feature, round(c1, 6) AS coef FROM two UNION ALL
    SELECT series, 'temperature', round(c2, 6) FROM two"""

QUERIES = [
    Query("select_f_regression", select_f_regression, sql("picked", """
        SELECT series, feature, n, round(r, 6) + 0.0 AS r, round(f_score, 6) AS f_score, CAST(rank AS INTEGER) AS rank, place FROM picked""")),
    Query("selected_names", selected_names, sql("picked", """
        SELECT series, string_agg(feature, ',' ORDER BY place) AS features, CAST(count(*) AS INTEGER) AS n_features
        FROM picked GROUP BY 1""")),
    Query("select_tree", select_tree),
    Query("standardise_fit_train", standardise_fit_train, sql("roles", ",\n        s AS (SELECT series, " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("temperature", "humidity", "pm25_lag_1"))
        + " FROM roles WHERE role = 'dev' GROUP BY 1)\n        SELECT series, datetime, role, " + ", ".join(
        f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in ("temperature", "humidity", "pm25_lag_1"))
        + " FROM roles JOIN s USING (series)")),
    Query("ridge_2feature", ridge_2feature, sql("two", """
        SELECT series, n, round(intercept, 6) AS intercept, round(c1, 6) + 0.0 AS coef_pm25_lag_1,
        round(c2, 6) + 0.0 AS coef_temperature FROM two""")),
    Query("coef_ranking", coef_ranking, sql("two", f"SELECT *, abs(coef) AS abs_coef FROM ({_TWO_LONG})")),
    Query("importance_table", importance_table, sql("two", f""",
        i AS (SELECT series, feature, abs(coef) AS importance FROM ({_TWO_LONG})),
        p AS (SELECT *, importance / sum(importance) OVER (PARTITION BY series) AS pct FROM i)
        SELECT series, feature, importance, round(pct, 6) AS pct, {family_case('feature')} AS family,
        CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(pct) OVER w, 6) AS cumulative, 'model' AS source FROM p
        WINDOW w AS (PARTITION BY series ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING)""")),
    Query("ridge_cv", ridge_cv),
    Query("ridge_scored", ridge_scored),
    Query("lasso_cv", lasso_cv),
    Query("random_forest", random_forest),
    Query("boosted_trees_a", boosted_trees_a),
    Query("boosted_trees_b", boosted_trees_b),
    Query("forest_cv", forest_cv),
    Query("boosted_cv_a", boosted_cv_a),
    Query("boosted_cv_b", boosted_cv_b),
    Query("regression_metrics", regression_metrics, sql("sides", "SELECT * FROM sides")),
    Query("fold_metrics", fold_metrics, sql("fold_rows", "SELECT * FROM fold_rows")),
    Query("cv_rollup", cv_rollup, sql("cvs", "SELECT * FROM cvs")),
    Query("metrics_flatten", metrics_flatten, sql("board", "SELECT * FROM board")),
    Query("model_leaderboard", model_leaderboard, sql("board", """
        SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY rmse, cv_val_r2 DESC, model) AS INTEGER) AS place,
        cv_gap <= 0.05 AS healthy FROM board""")),
    Query("select_best_model", select_best_model, sql("best", "SELECT * FROM best")),
    Query("select_best_min_gap", select_best_min_gap, sql("board", _best("cv_gap, cv_val_r2 DESC", "min_cv_gap_then_cv_val_r2"))),
    Query("promote_contract", promote_contract, sql("best", f"""
        SELECT series, model AS model_name, 'pm25' AS target, false AS requires_scaling,
        CASE model {' '.join(f"WHEN '{m}' THEN '{c}'" for m, c in PREDICTORS.items())} END AS features,
        1 AS n_features, selected_by, cv_val_r2, cv_gap AS cv_r2_gap, rmse AS test_rmse, r2_gap AS test_r2_gap FROM best""")),
    Query("registry_append", registry_append, sql("entries", "SELECT * FROM entries")),
    Query("registry_latest", registry_latest, sql("entries", """
        SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY model ORDER BY version DESC) = 1""")),
    Query("registry_metrics", registry_metrics, sql("best", """
        SELECT series, model, metric, value FROM (UNPIVOT (SELECT series, model, rmse, mae, r2, cv_val_r2, cv_gap, r2_gap FROM best)
        ON rmse, mae, r2, cv_val_r2, cv_gap, r2_gap INTO NAME metric VALUE value)""")),
    Query("score_linear", score_linear, sql("features", f"SELECT series, datetime, round({_SCORE}, 6) AS predicted FROM features")),
    Query("backtest_72", backtest_72, sql("backtests", "SELECT * FROM backtests")),
    Query("backtest_mae", backtest_mae, sql("backtests", """
        SELECT series, count(*) AS n_hours, round(avg(abs(actual_pm25 - predicted_pm25)), 4) AS mae FROM backtests GROUP BY 1""")),
    Query("recursive_forecast", recursive_forecast, _forecast_sql("SELECT * FROM forecast")),
    Query("forecast_with_trees", forecast_with_trees),
    Query("forecast_boosted", forecast_boosted),
    Query("trained_leaderboard", trained_leaderboard),
    Query("promoted_scores", promoted_scores),
    Query("promoted_forecast", promoted_forecast),
    Query("tree_shap", tree_shap),
    Query("forecast_summary", forecast_summary, _forecast_sql(f""",
        k AS (SELECT series, count(*) AS n_hours, avg(predicted_pm25) AS m, max(predicted_pm25) AS max_value,
              min(predicted_pm25) AS min_value, min(datetime) AS first_hour, max(datetime) AS last_hour FROM forecast GROUP BY 1),
        c AS (SELECT series, {band_case('predicted_pm25')} AS dominant, count(*) AS n, min(predicted_pm25) AS lo FROM forecast GROUP BY 1, 2),
        d AS (SELECT series, dominant FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, lo) = 1)
        SELECT series, n_hours, round(m, 6) AS mean_value, max_value, min_value, first_hour, last_hour,
        {band_case('m')} AS mean_category, {band_case('max_value')} AS peak_category, dominant FROM k JOIN d USING (series)""")),
    Query("linear_shap", linear_shap, sql("features", """,
        s AS (SELECT * FROM features)
        """ + " UNION ALL ".join(
        f"SELECT series, '{f}' AS feature, round(avg(abs(({f} - m) * ({c / s}))), 6) AS mean_abs_shap FROM "
        f"(SELECT series, {f}, avg({f}) OVER (PARTITION BY series) AS m FROM s) GROUP BY 1"
        for f, c, s in zip(SCORER.contract.features, SCORER.coefs, SCORER.stds)))),
    Query("permutation_importance", permutation_importance, sql("features", f""",
        o AS (SELECT *, md5(series || '|' || CAST(datetime AS VARCHAR)) AS spot FROM features),
        s AS (SELECT *, {', '.join(f"coalesce(lead({f}) OVER w, first_value({f}) OVER w) AS other_{i}"
                                   for i, f in enumerate(SCORER.contract.features))}
              FROM o WINDOW w AS (PARTITION BY series ORDER BY spot, datetime)),
        e AS (SELECT {_RMSE.format(_SCORE)} AS base, {', '.join(
            f"{_RMSE.format(_swapped(i))} AS rmse_{i}" for i in range(len(SCORER.contract.features)))} FROM s)
        """ + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(rmse_{i} - base, 6) + 0.0 AS importance, "
                                 f"{family_case(repr(f))} AS family FROM e" for i, f in enumerate(SCORER.contract.features)))),
]

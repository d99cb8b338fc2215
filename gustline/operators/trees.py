"""Forests through Spark ML and boosted trees, with expanding-window cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.operators.blocks import IDX, SIZE
from gustline.operators.boosting import BOOST_A, BoostedModel, BoostParams, TRAIN, VAL, fit_boosted, score_boosted
from gustline.operators.metrics import fold_metrics, metric_columns
from gustline.operators.selection import select_tree
from gustline.operators.splits import development, fold_roles, holdout, holdout_size, ts_folds

TREE_FEATURES = 10
# Parameters of the forest.
FOREST_PARAMS = {"numTrees": 400, "maxDepth": 4, "minInstancesPerNode": 20,
                 "featureSubsetStrategy": "0.4", "subsamplingRate": 0.7, "seed": 42}


def _assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features")


def fit_forest(df: DataFrame, y: str, cols: Sequence[str], **params) -> PipelineModel:
    forest = RandomForestRegressor(labelCol=y, predictionCol="predicted", **{**FOREST_PARAMS, **params})
    return Pipeline(stages=[_assembler(cols), forest]).fit(df.select(y, *cols))


Fit = Callable[[DataFrame, DataFrame, Sequence[str]], PipelineModel]


def tree_cv(df: DataFrame, y: str, cols: Sequence[str], series_cols: Sequence[str], fit: Fit, k: int = 3,
            top: int = TREE_FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """Per-fold metrics with nested selection; ``fit(train, val, features)`` gives the model.

    The loop runs over the k folds; the rows of a fold are selected, fitted and scored by Spark.
    """
    folds = ts_folds(development(df, series_cols), series_cols, k).persist()
    try:
        rows = []
        for fold in range(1, k + 1):
            part = folds.where(F.col("fold") == fold)
            train, val = (part.where(F.col("role") == r) for r in ("train", "val"))
            features = [r["feature"] for r in select_tree(train, y, cols, top).collect()]
            scored = fold_metrics(fit(train, val, features).transform(part), y, "predicted", by)
            rows += scored.collect()        # one row per fold and group
        return df.sparkSession.createDataFrame(rows, scored.schema)
    finally:
        folds.unpersist()


def _final_role() -> Column:
    """The tail of the development rows decides when to stop, the rows before it train."""
    return F.when(F.col(IDX) > F.col(SIZE) - holdout_size(F.col(SIZE)), VAL).otherwise(TRAIN).cast("tinyint")


def fit_boosted_final(df: DataFrame, y: str, cols: Sequence[str], series_cols: Sequence[str], params: BoostParams = BOOST_A,
                      top: int = TREE_FEATURES) -> BoostedModel:
    """Features selected on the development rows, then boosted trees that stop by the tail of these rows."""
    dev = development(df, series_cols)
    features = [r["feature"] for r in select_tree(dev, y, cols, top).collect()]
    return fit_boosted(dev.withColumn("roles", F.array(_final_role())), y, [features], params)[0]


def boosted_cv(df: DataFrame, y: str, cols: Sequence[str], series_cols: Sequence[str], params: BoostParams = BOOST_A, k: int = 3,
               top: int = TREE_FEATURES, by: Sequence[str] = (), final: bool = False) -> tuple[DataFrame, list[BoostedModel]]:
    """Per-fold metrics of boosted trees with nested selection, and the models of the folds.

    All folds are fitted side by side over one table of binned rows; ``final`` adds the fit on all development rows as the last model.
    """
    dev = fold_roles(development(df, series_cols), series_cols, k)
    sides = [dev.where(F.get("roles", F.lit(i)) == TRAIN) for i in range(k)] + [dev] * final
    features = [[r["feature"] for r in select_tree(side, y, cols, top).collect()] for side in sides]
    if final:
        dev = dev.withColumn("roles", F.concat("roles", F.array(_final_role())))
    models = fit_boosted(dev, y, features, params)
    rows = None
    for i, model in enumerate(models[:k]):
        part = dev.withColumns({"fold": F.lit(i + 1), "role": F.get("roles", F.lit(i))}).where(F.col("role") > 0)
        part = score_boosted(part.select(*by, y, "fold", "role", *[c for c in model.features if c not in by]), model)
        part = part.select(*by, y, "fold", F.when(F.col("role") == TRAIN, "train").otherwise("val").alias("role"), "predicted")
        rows = part if rows is None else rows.unionByName(part)
    return fold_metrics(rows, y, "predicted", by), models


def score_trees(df: DataFrame, model: PipelineModel | BoostedModel) -> DataFrame:
    """Add ``predicted`` with a forest of Spark ML or an ensemble as arrays."""
    return score_boosted(df, model) if isinstance(model, BoostedModel) else model.transform(df)


def final_metrics(model: PipelineModel | BoostedModel, df: DataFrame, y: str, series_cols: Sequence[str],
                  by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R² on the development and the test rows."""
    scored = score_trees(holdout(df, series_cols), model)
    return scored.groupBy(*by, "role").agg(F.count(F.lit(1)).alias("n"), *metric_columns(y, "predicted"))


def importance_table(model: PipelineModel | BoostedModel, cols: Sequence[str], spark) -> DataFrame:
    """Native importances of a fitted model; a length that does not fit the contract is an error."""
    native = model.importances() if isinstance(model, BoostedModel) else model.stages[-1].featureImportances.toArray()
    values = [float(v) for v in native]
    if len(values) != len(cols):
        raise ValueError("importances and features differ in length")
    return spark.createDataFrame(list(zip(cols, values, ["model"] * len(cols))),
                                 "feature string, importance double, source string")


def forest_ensemble(spark: SparkSession, path: str, cols: Sequence[str]) -> BoostedModel:
    """A forest that Spark ML has saved, as an ensemble of arrays; the trees, not the rows, bound its size.

    ``path`` is the folder of the saved forest stage. Every tree is laid out as a complete one; the rows of a node that does not split go left.
    """
    import numpy as np

    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r

    def height(nodes, n) -> int:
        return 0 if nodes[n]["leftChild"] < 0 else 1 + max(height(nodes, nodes[n]["leftChild"]), height(nodes, nodes[n]["rightChild"]))

    depth = max(1, *(height(t, 0) for t in trees.values()))
    inner = 2 ** depth - 1
    feature, threshold = np.zeros((len(trees), inner), np.int32), np.full((len(trees), inner), np.inf)
    value, cover = np.zeros((len(trees), inner + 1)), np.zeros((len(trees), inner + 1))
    for t, number in enumerate(sorted(trees)):
        nodes, waiting = trees[number], [(0, 0)]
        while waiting:
            n, at = waiting.pop()
            row = nodes[n]
            if row["leftChild"] >= 0:
                feature[t, at], threshold[t, at] = row["split"]["featureIndex"], row["split"]["leftCategoriesOrThreshold"][0]
                waiting += [(row["leftChild"], 2 * at + 1), (row["rightChild"], 2 * at + 2)]
                continue
            while at < inner:
                at = 2 * at + 1
            value[t, at - inner], cover[t, at - inner] = row["prediction"] / len(trees), row["rawCount"]
    return BoostedModel(list(cols), 0.0, feature, threshold, value, cover)

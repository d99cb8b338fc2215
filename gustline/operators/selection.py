"""Feature selection and standardisation in SQL-side aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.operators.blocks import salted_lookup
from gustline.operators.metrics import correlation

LINEAR_K = 12
TREE_K = 15
# Features a linear model always keeps, and the selecting forest's parameters.
MUST_HAVE = ["pm25_lag_1", "pm25_lag_24", "pm25_roll_mean_24"]
SELECTION_FOREST = {"numTrees": 50, "maxDepth": 5, "minInstancesPerNode": 5, "seed": 42}


def f_regression(df: DataFrame, y: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """F of the univariate regression of ``y`` on each column, from one pass of correlations.

    A constant column has none (null), one that lies on a line with ``y`` an infinite one.
    """
    wide = df.groupBy(*by).agg(F.count(y).alias("n"), *[correlation(c, y).alias(c) for c in cols])
    long = wide.unpivot([*by, "n"], list(cols), "feature", "r")
    r2 = F.col("r") * F.col("r")
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    return long.withColumn("position", place).withColumn(
        "f_score", F.when(r2 == 1, F.lit(float("inf"))).otherwise(r2 / (1 - r2) * (F.col("n") - 2)))


def select_f_regression(df: DataFrame, y: str, cols: Sequence[str], k: int = LINEAR_K,
                        must_have: Sequence[str] = tuple(MUST_HAVE), by: Sequence[str] = ()) -> DataFrame:
    """The top ``k`` columns by F in column order, then the must-haves that are not among them.

    Of equal scores the later column wins. ``place`` is the order of the selection.
    """
    scores = f_regression(df, y, cols, by)
    best = Window.partitionBy(*by).orderBy(F.desc_nulls_last("f_score"), F.desc("position"))
    forced = [c for c in must_have if c in cols]
    forced_place = F.array_position(F.array(*[F.lit(c) for c in forced]), F.col("feature")) if forced else F.lit(0)
    ranked = scores.withColumn("rank", F.row_number().over(best))
    kept = ranked.withColumn("by_score", F.col("rank") <= k) \
        .where(F.col("by_score") | F.col("feature").isin(forced))
    order = Window.partitionBy(*by).orderBy(
        F.desc("by_score"), F.when(F.col("by_score"), F.col("position")).otherwise(forced_place))
    return kept.withColumn("place", F.row_number().over(order)).drop("position")


def selected_names(selection: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The selection as one array per group."""
    pairs = F.array_sort(F.collect_list(F.struct("place", "feature")))     # at most one per column
    return selection.groupBy(*by).agg(pairs.alias("_p")).select(*by, F.col("_p.feature").alias("features"))


def select_tree(df: DataFrame, y: str, cols: Sequence[str], k: int = TREE_K, **params) -> DataFrame:
    """The top ``k`` columns by the importance in a small forest; ties keep the column order."""
    forest = RandomForestRegressor(featuresCol="_features", labelCol=y, **{**SELECTION_FOREST, **params})
    model = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_features"), forest]) \
        .fit(df.select(y, *cols))
    importances = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    ranked = sorted(range(len(cols)), key=lambda i: (-importances[i], i))[:k]
    rows = [(place, cols[i], importances[i]) for place, i in enumerate(ranked, 1)]
    return df.sparkSession.createDataFrame(rows, "place int, feature string, importance double")


def scaler_stats(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per group, of the training rows only."""
    return train.groupBy(*by).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_std_{c}") for c in cols])


def standardise(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / std with the given statistics; a constant column is only centred."""
    joined = salted_lookup(df, stats, [*by]) if by else df.join(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_mean_{c}"))
              / F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(F.lit(1.0)) for c in cols}
    return joined.withColumns(scaled).drop(*[f"_{s}_{c}" for s in ("mean", "std") for c in cols])

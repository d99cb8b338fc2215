"""Model comparison, promotion and the model registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.operators.blocks import null_safe_join

GAP_LIMIT = 0.05
# Models whose inputs are standardised.
SCALED_MODELS = ["ridge"]
POLICY_NAMES = {
    "min_rmse": "min_rmse_then_cv_val_r2_among_healthy",
    "min_gap": "min_cv_gap_then_cv_val_r2",
    "cv_val_r2": "cv_val_r2",
}


def _policy_order(policy: str) -> list[Column]:
    orders = {
        "min_rmse": [F.asc("rmse"), F.desc("cv_val_r2")],
        "min_gap": [F.asc("cv_gap"), F.desc("cv_val_r2")],
        "cv_val_r2": [F.desc("cv_val_r2"), F.asc("rmse")],
    }
    return [*orders[policy], F.asc("model")]


def leaderboard(metrics: DataFrame, by: Sequence[str] = (), policy: str = "min_rmse") -> DataFrame:
    """Models of a group, best first, with the gate on the cross-validation gap."""
    order = Window.partitionBy(*by).orderBy(*_policy_order(policy))
    return metrics.withColumns({"place": F.row_number().over(order), "healthy": F.col("cv_gap") <= GAP_LIMIT})


def select_best(metrics: DataFrame, by: Sequence[str] = (), policy: str = "min_rmse",
                gap_limit: float = GAP_LIMIT) -> DataFrame:
    """The best model per group.

    Models with a gap above the limit only compete where no model is below it; models without
    a gap or an RMSE never do.
    """
    group = Window.partitionBy(*by)
    pool = metrics.where(F.col("cv_gap").isNotNull() & F.col("rmse").isNotNull())
    pool = pool.withColumn("_healthy", F.col("cv_gap") <= gap_limit)
    pool = pool.withColumn("_any", F.max("_healthy").over(group)).where(F.col("_healthy") | ~F.col("_any"))
    return (pool.withColumn("_place", F.row_number().over(group.orderBy(*_policy_order(policy))))
            .where(F.col("_place") == 1).drop("_place", "_healthy", "_any")
            .withColumn("selected_by", F.lit(POLICY_NAMES[policy])))


def promote(best: DataFrame, records: DataFrame, by: Sequence[str] = (), target: str = "pm25",
            scaled_models: Sequence[str] = tuple(SCALED_MODELS)) -> DataFrame:
    """The scoring contract of the chosen model: its features and metrics.

    ``records`` needs ``model`` and ``features``; a model without features gets no contract.
    """
    keys = [*by, "model"]
    return null_safe_join(best, records.select(*keys, "features"), keys).where(F.col("features").isNotNull()).select(
        *by, F.col("model").alias("model_name"), F.lit(target).alias("target"),
        F.col("model").isin(list(scaled_models)).alias("requires_scaling"), "features",
        F.size("features").alias("n_features"), "selected_by", "cv_val_r2",
        F.col("cv_gap").alias("cv_r2_gap"),
        F.struct("mae", "rmse", "r2").alias("test_metrics"), F.col("r2_gap").alias("test_r2_gap"))


def registry_append(registry: DataFrame, new: DataFrame, name: str = "model") -> DataFrame:
    """The registry with the new entries as the next version of their model."""
    last = registry.groupBy(name).agg(F.max("version").alias("_last"))
    order = Window.partitionBy(name).orderBy(*[F.asc(c) for c in new.columns if c != name])
    numbered = (new.join(last, name, "left")
                .withColumn("version", (F.coalesce(F.col("_last"), F.lit(0)) + F.row_number().over(order))
                            .cast(dict(registry.dtypes)["version"])).drop("_last"))
    return registry.unionByName(numbered, allowMissingColumns=True)


def registry_latest(registry: DataFrame, name: str = "model") -> DataFrame:
    """The newest version of every model."""
    rest = [c for c in registry.columns if c not in (name, "version")]
    return registry.groupBy(name).agg(
        F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("_row")
    ).select(name, "version", "_row.*")

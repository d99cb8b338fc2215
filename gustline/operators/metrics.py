"""Regression metrics, cross-validation roll-ups and metric records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions.bands import gap_verdict
from gustline.operators.blocks import null_safe_join


def metric_columns(y: Column | str, yhat: Column | str, digits: int | None = 4) -> list[Column]:
    """MAE, RMSE and R² of one group, as aggregate columns."""
    y = F.col(y) if isinstance(y, str) else y
    yhat = F.col(yhat) if isinstance(yhat, str) else yhat
    e = y - yhat
    n = F.count(e)
    both = F.when(e.isNotNull(), y)
    spread = F.var_pop(both) * n
    out = {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": F.when(spread > 0, 1 - F.sum(e * e) / spread),
    }
    return [(F.round(c, digits) if digits is not None else c).alias(name) for name, c in out.items()]


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the rows that hold both; null where either is constant, which ``F.corr`` takes for an error.

    Smallest and largest value tell a constant: means merged from several tasks are rounded and leave it a spread.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    shared, spread = F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(varies & (spread > 0) & ~F.isnan(shared), F.least(F.greatest(shared / spread, F.lit(-1.0)), F.lit(1.0)))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (),
                       digits: int | None = 4) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *metric_columns(y, yhat, digits))


def fold_metrics(folds: DataFrame, y: str, yhat: str, by: Sequence[str]) -> DataFrame:
    """Per fold: train and validation RMSE and R² and their ratio, rounded to 4 places."""
    sides = folds.groupBy(*by, "fold", "role").agg(*metric_columns(y, yhat, None))
    pick = lambda role, m: F.max(F.when(F.col("role") == role, F.col(m)))
    return (sides.groupBy(*by, "fold").agg(
                pick("train", "rmse").alias("train_rmse"), pick("val", "rmse").alias("val_rmse"),
                pick("train", "r2").alias("train_r2"), pick("val", "r2").alias("val_r2"))
            .withColumn("ratio", F.round(F.col("val_rmse") / F.col("train_rmse"), 4))
            .withColumns({c: F.round(c, 4) for c in ("train_rmse", "val_rmse", "train_r2", "val_r2")}))


def cv_rollup(folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means over the (already rounded) folds, their gap, the median ratio and the verdict."""
    gap = F.avg("train_r2") - F.avg("val_r2")
    return folds.groupBy(*by).agg(
        F.round(F.avg("train_r2"), 4).alias("mean_train_r2"),
        F.round(F.avg("val_r2"), 4).alias("mean_val_r2"),
        F.round(gap, 4).alias("r2_gap"),
        gap_verdict(gap).alias("verdict"),
        # k values per group, so the exact percentile is bounded
        F.round(F.percentile("ratio", F.lit(0.5)), 4).alias("rmse_ratio_median"),
        F.count(F.lit(1)).alias("n_splits"))


def metrics_record(cv: DataFrame, sides: DataFrame, by: Sequence[str]) -> DataFrame:
    """One nested record per model: ``cv``, ``train``, ``test`` and the test gap.

    ``sides`` holds one row per (model, role) with role "dev" or "test". A model without test
    rows keeps a null ``test``.
    """
    fields = ["mae", "rmse", "r2"]
    pick = lambda role: F.max(F.when(F.col("role") == role, F.struct(*fields)))
    parts = sides.groupBy(*by).agg(pick("dev").alias("train"), pick("test").alias("test"))
    block = [c for c in cv.columns if c not in by]
    return (null_safe_join(parts, cv.select(*by, F.struct(*block).alias("cv")), by, "left")
            .withColumn("test_r2_gap", F.round(F.col("train.r2") - F.col("test.r2"), 4)))


def leaderboard_rows(records: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Flat leaderboard rows; records without a test block are left out."""
    return records.where(F.col("test").isNotNull()).select(
        *by, F.col("test.mae").alias("mae"), F.col("test.rmse").alias("rmse"), F.col("test.r2").alias("r2"),
        F.col("test_r2_gap").alias("r2_gap"), F.col("cv.mean_val_r2").alias("cv_val_r2"),
        F.col("cv.r2_gap").alias("cv_gap"))


def registry_metrics(best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The numeric, non-null metrics of a record as (metric, value) rows."""
    # The metrics a registry entry shows.
    names = ["rmse", "mae", "r2", "cv_val_r2", "cv_gap", "r2_gap"]
    have = [n for n in names if n in best.columns]
    return (best.select(*keys, *[F.col(n).cast("double") for n in have])
            .unpivot([*keys], have, "metric", "value").where(F.col("value").isNotNull()))

"""Chronological splits. All of them are arithmetic on the row position in the series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.operators.blocks import IDX, SIZE, with_row_index

RECENT_ROWS = 72
MIN_EXTRA_ROWS = 10
HOLDOUT_FRACTION = 0.15
HOLDOUT_MIN = 24
FIXED_HOLDOUT = 7 * 24


def _indexed(df: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    return df if IDX in df.columns and SIZE in df.columns else with_row_index(df, series_cols)


def split_recent(df: DataFrame, series_cols: Sequence[str], n: int = RECENT_ROWS) -> DataFrame:
    """Adds ``role``: the last ``n`` rows of a series are "recent", the rest "reference"."""
    rows = _indexed(df, series_cols)
    return (rows.withColumn("role", F.when(F.col(IDX) > F.col(SIZE) - n, "recent").otherwise("reference"))
            .drop(IDX, SIZE))


def latest_rows(df: DataFrame, series_cols: Sequence[str], n: int = RECENT_ROWS) -> DataFrame:
    return split_recent(df, series_cols, n).where(F.col("role") == "recent").drop("role")


def enough_rows(df: DataFrame, series_cols: Sequence[str], n: int = RECENT_ROWS) -> DataFrame:
    """Series long enough for a reference/recent comparison."""
    return (df.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("enough", F.col("n_rows") > n + MIN_EXTRA_ROWS))


def holdout_size(n: Column, fraction: float = HOLDOUT_FRACTION, minimum: int = HOLDOUT_MIN) -> Column:
    return F.greatest(F.floor(F.lit(fraction) * n), F.lit(minimum))


def holdout(df: DataFrame, series_cols: Sequence[str], fraction: float = HOLDOUT_FRACTION,
            minimum: int = HOLDOUT_MIN, fixed: int | None = None) -> DataFrame:
    """Adds ``role``: the tail of a series is "test", the rest "dev". ``fixed`` asks for a tail
    of that many rows. Keeps the position columns."""
    rows = _indexed(df, series_cols)
    size = F.lit(fixed) if fixed is not None else holdout_size(F.col(SIZE), fraction, minimum)
    return rows.withColumn("role", F.when(F.col(IDX) > F.col(SIZE) - size, "test").otherwise("dev"))


def development(df: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """The rows before the holdout; positions stay valid, the size becomes the dev size."""
    rows = _indexed(df, series_cols)
    return (rows.withColumn(SIZE, F.col(SIZE) - holdout_size(F.col(SIZE)))
            .where(F.col(IDX) <= F.col(SIZE)))


def ts_folds(df: DataFrame, series_cols: Sequence[str], k: int = 3) -> DataFrame:
    """Expanding-window folds: one output row per (row, fold) it takes part in.

    With n rows the test size is n div (k + 1); fold i validates on one such stretch and trains
    on every row before it.
    """
    rows = _indexed(df, series_cols)
    step = F.floor(F.col(SIZE) / F.lit(k + 1))
    plan = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(
        i.alias("fold"),
        F.when(F.col(IDX) <= F.col(SIZE) - (F.lit(k + 1) - i) * step, "train")
         .when(F.col(IDX) <= F.col(SIZE) - (F.lit(k) - i) * step, "val").alias("role")))
    return (rows.select("*", F.inline(F.filter(plan, lambda p: p["role"].isNotNull())))
            .drop(IDX, SIZE))


def fold_roles(df: DataFrame, series_cols: Sequence[str], k: int = 3) -> DataFrame:
    """Adds ``roles``: for each of the folds of ``ts_folds`` what the row is to it, 0 nothing, 1 train, 2 validation.

    One row stays one row, for fits that go over all folds at once. Keeps the position columns.
    """
    rows = _indexed(df, series_cols)
    step = F.floor(F.col(SIZE) / F.lit(k + 1))
    roles = [F.when(F.col(IDX) <= F.col(SIZE) - (k + 1 - i) * step, 1).when(F.col(IDX) <= F.col(SIZE) - (k - i) * step, 2).otherwise(0)
             for i in range(1, k + 1)]
    return rows.withColumn("roles", F.array(*[r.cast("tinyint") for r in roles]))


def fold_summary(folds: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    return folds.groupBy(*series_cols, "fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("datetime").alias("first_hour"),
        F.max("datetime").alias("last_hour"))


def latest_row(df: DataFrame, series_cols: Sequence[str], ts: str = "datetime") -> DataFrame:
    """The last row of every series, by one aggregation with partial results."""
    rest = [c for c in df.columns if c not in series_cols]
    return (df.groupBy(*series_cols).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_row"))
            .select(*series_cols, "_row.*").select(*df.columns))

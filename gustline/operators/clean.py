"""Profiling, validation and column selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gustline.functions.bands import missing
from gustline.spec import NON_NEGATIVE, Contract

NULL_THRESHOLD = 0.80


def _is_null(df: DataFrame, name: str) -> Column:
    dtype = dict(df.dtypes)[name]
    return missing(name) if dtype in ("double", "float") else F.col(name).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares as the largest value in Spark; null does not compare at all."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates removed, column names in lower case."""
    return df.dropDuplicates().toDF(*[c.lower() for c in df.columns])


def preprocess(df: DataFrame, ts: str = "datetime") -> DataFrame:
    out = dedupe_rows(df)
    return out.withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def profile(df: DataFrame, nonneg_cols: Sequence[str] = tuple(NON_NEGATIVE)) -> DataFrame:
    """One row per column: nulls, null ratio and negatives, from a single pass."""
    cols = df.columns
    checked = [c for c in nonneg_cols if c in cols]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(_is_null(df, c)).alias(f"_null_{i}") for i, c in enumerate(cols)]
    aggs += [F.count_if((F.col(c) < 0) & ~missing(c)).alias(f"_neg_{c}") for c in checked]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"), F.col(f"_null_{i}").alias("n_null"),
        (F.col(f"_null_{i}") / F.col("_n")).alias("null_ratio"),
        (F.col(f"_neg_{c}") if c in checked else F.lit(None).cast("bigint")).alias("n_negative"),
    ) for i, c in enumerate(cols)])))


def sparse_columns(df: DataFrame, null_threshold: float = NULL_THRESHOLD) -> list[str]:
    """Columns that are all null, or null in more than the given share of the rows.

    The only thing that reaches the driver is one count per column.
    """
    counts = df.agg(F.count(F.lit(1)), *[F.count_if(_is_null(df, c)) for c in df.columns]).first()
    n = counts[0]
    return [c for c, nulls in zip(df.columns, counts[1:]) if nulls == n or nulls > null_threshold * n]


def validate(df: DataFrame, nonneg_cols: Sequence[str] = tuple(NON_NEGATIVE),
             null_threshold: float = NULL_THRESHOLD) -> DataFrame:
    """Drop sparse columns, rows with a negative reading and rows with any null."""
    out = df.drop(*sparse_columns(df, null_threshold))
    for c in nonneg_cols:
        if c in out.columns:
            out = out.where(F.col(c) >= 0)
    return nan_to_null(out).na.drop("any")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


# Columns that are no candidates for a forecasting model.
NOT_PREDICTORS = ["datetime", "pm25", "pm10", "co", "no2", "so2", "o3", "aod", "dust",
                  "pm25_roll_mean_3", "pm25_roll_std_3"]


def candidate_features(df: DataFrame, target: str = "pm25",
                       not_predictors: Sequence[str] = tuple(NOT_PREDICTORS)) -> tuple[DataFrame, list[str]]:
    """Rows with a target, and the numeric columns a forecasting model may use."""
    rows = df.where(~missing(target))
    return rows, numeric_columns(rows.drop(*not_predictors), exclude=[target])


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def features_to_check(df: DataFrame, contract: Contract | None = None,
                      exclude: Sequence[str] = ("pm25", "datetime")) -> list[str]:
    """The contract's features that exist, else all numeric columns but the target."""
    if contract is not None:
        have = existing_columns(df, contract.features)
        if have:
            return have
    return numeric_columns(df, exclude)


def contract_select(df: DataFrame, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """The contract's features, in its order; a missing one is an error."""
    lacking = [c for c in contract.features if c not in df.columns]
    if lacking:
        raise ValueError(f"contract {contract.model_name} asks for columns that are not there: {lacking}")
    return df.select(*keep, *[c for c in contract.features if c not in keep])


def conform(df: DataFrame, layout: DataFrame) -> DataFrame:
    """The columns of another table, in its order; absent ones become null."""
    types = dict(layout.dtypes)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c)
                       for c in layout.columns])

"""Attribution of predictions to features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.operators.blocks import salted_lookup
from gustline.operators.metrics import metric_columns
from gustline.operators.splits import latest_rows
from gustline.spec import LinearModel

BUCKET_ROWS = 8192
PREFIX_BITS = 20    # of the MD5 that a bucket may use


def attribution_sample(df: DataFrame, features: Sequence[str], series_cols: Sequence[str],
                       n: int | None = None) -> DataFrame:
    """The rows that have all features; on request the last ``n`` of each series."""
    whole = df.na.drop("any", subset=list(features))
    return whole if n is None else latest_rows(whole, series_cols, n)


def linear_attribution(df: DataFrame, model: LinearModel, series_cols: Sequence[str],
                       n: int | None = None) -> DataFrame:
    """Mean absolute SHAP value per feature of a linear model, over all rows or the last ``n`` of each series.

    For a linear model it is slope * (x - mean of the sample), so two small aggregations over
    the sample are exact.
    """
    features = model.contract.features
    sample = attribution_sample(df, features, series_cols, n).select(*series_cols, *features)
    centre = sample.groupBy(*series_cols).agg(*[F.avg(c).alias(f"_m_{c}") for c in features])
    joined = salted_lookup(sample, centre, series_cols) if series_cols else sample.join(F.broadcast(centre))  # one row
    scale = model.stds if model.contract.requires_scaling else [1.0] * len(features)
    wide = joined.groupBy(*series_cols).agg(*[
        F.avg(F.abs((F.col(c) - F.col(f"_m_{c}")) * F.lit(model.coefs[i] / scale[i]))).alias(c)
        for i, c in enumerate(features)])
    return wide.unpivot([*series_cols], features, "feature", "mean_abs_shap")


def permutation_importance(df: DataFrame, predict: Callable[[DataFrame], DataFrame], y: str,
                           features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rise of the RMSE when one feature is taken from another row, per feature.

    The other row is the next one of the series in a fixed pseudo-random order (by the MD5 of key and time; the
    first one for the last), whatever the number of rows. A series is cut into ranges of the MD5 of about
    ``BUCKET_ROWS`` rows, by its own size, so no task gets a whole long series; the last row of a range takes the
    first one of the next range that has rows. All features are scored in one pass.
    """
    from pyspark.sql import Window

    spot = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, "datetime")]).cast("binary"))
    series = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))    # nulls in it are equal to each other
    marked = df.withColumns({"_series": series, "_spot": spot})
    sizes = marked.groupBy("_series").agg(F.count(F.lit(1)).alias("_rows"))
    buckets = F.least(F.ceil(F.col("_rows") / BUCKET_ROWS), F.lit(1 << PREFIX_BITS))
    prefix = F.conv(F.substring("_spot", 1, PREFIX_BITS // 4), 16, 10).cast("bigint")
    marked = (salted_lookup(marked, sizes, ["_series"])
              .withColumn("_bucket", F.floor(prefix * buckets / F.lit(1 << PREFIX_BITS)).cast("bigint")))

    row = F.struct(*[F.col(c).alias(f"_o_{c}") for c in features])
    firsts = marked.groupBy("_series", "_bucket").agg(F.min_by(row, F.struct("_spot", "datetime", row)).alias("_first"))
    along = Window.partitionBy("_series").orderBy("_bucket")    # one row per bucket
    all_of = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("_series", "_bucket", F.coalesce(
        F.lead("_first").over(along), F.first("_first").over(all_of)).alias("_after"))

    inside = Window.partitionBy("_series", "_bucket").orderBy("_spot", "datetime", row)
    df = (salted_lookup(marked, after, ["_series", "_bucket"])
          .withColumn("_other", F.coalesce(F.lead(row).over(inside), F.col("_after")))
          .select(*df.columns, *[F.col(f"_other._o_{c}") for c in features]))
    rows = df.withColumn(
        "feature", F.explode(F.array(F.lit(""), *[F.lit(c) for c in features])))
    swapped = rows.withColumns({
        c: F.when(F.col("feature") == c, F.col(f"_o_{c}")).otherwise(F.col(c)) for c in features})
    errors = predict(swapped).groupBy("feature").agg(*metric_columns(y, "predicted", None))
    base = errors.where(F.col("feature") == "").select(F.col("rmse").alias("base"))
    return (errors.where(F.col("feature") != "").join(F.broadcast(base))    # one row
            .select("feature", (F.col("rmse") - F.col("base")).alias("importance")))

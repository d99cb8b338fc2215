"""Overview, quality and distribution tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.bands import PM25_BANDS, feature_family, missing, pm25_band_order, pm25_category
from gustline.operators.blocks import salted_lookup
from gustline.operators.clean import numeric_columns
from gustline.operators.metrics import correlation
from gustline.operators.order_stats import group_quantiles

# Order of the weekdays.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def overview(df: DataFrame, by: Sequence[str] = (), ts: str = "datetime") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_hour"), F.max(ts).alias("last_hour"),
        F.avg("pm25").alias("mean_pm25"), F.max("pm25").alias("max_pm25"), F.min("pm25").alias("min_pm25"),
        F.avg("pm10").alias("mean_pm10"))


def data_quality(df: DataFrame) -> DataFrame:
    """Row count, duplicate rows, missing values and their share of all cells."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    nulls = sum((F.when(missing(c) if c in floats else F.col(c).isNull(), 1).otherwise(0)
                 for c in df.columns), F.lit(0))
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return (distinct.agg(
                F.sum("_copies").alias("total_rows"),
                F.sum(F.col("_copies") - 1).alias("duplicate_rows"),
                F.sum(nulls * F.col("_copies")).alias("missing_values"))
            .withColumn("missing_pct", F.col("missing_values") / (F.col("total_rows") * len(df.columns)) * 100))


def category_distribution(df: DataFrame, value: str = "pm25", by: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*by, pm25_category(value).alias("category")).agg(F.count(F.lit(1)).alias("n")))


def weekday_mean(df: DataFrame, value: str = "pm25", by: Sequence[str] = (), ts: str = "datetime") -> DataFrame:
    """Mean per weekday from Monday to Sunday; a weekday without rows stays, with null."""
    day = F.weekday(ts)
    means = df.groupBy(*by).agg(*[F.avg(F.when(day == i, F.col(value))).alias(f"_{i}")
                                  for i in range(len(WEEKDAYS))])
    return means.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("weekday"), F.col(f"_{i}").alias("mean_value"))
        for i, name in enumerate(WEEKDAYS)])))


def diurnal_boxplot(df: DataFrame, value: str = "pm25", by: Sequence[str] = (), ts: str = "datetime") -> DataFrame:
    """Minimum, quartiles and maximum per hour of the day."""
    keyed = df.select(*by, F.hour(ts).alias("hour"), value)
    q = group_quantiles(keyed, [*by, "hour"], value, [0, .25, .5, .75, 1], bounded_keys=not by)
    names = ["min_value", "q1", "median", "q3", "max_value"]
    return q.select(*by, "hour", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def daily_outlook(df: DataFrame, value: str = "pm25", by: Sequence[str] = (), ts: str = "datetime") -> DataFrame:
    """Mean, minimum and maximum per day with the band of the mean."""
    return (df.groupBy(*by, F.to_date(ts).alias("day"))
            .agg(F.avg(value).alias("mean_value"), F.min(value).alias("min_value"),
                 F.max(value).alias("max_value"))
            .withColumn("category", pm25_category("mean_value")))


def abs_correlations(df: DataFrame, target: str = "pm25", cols: Sequence[str] | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """|Pearson correlation| of every numeric column with the target, in one pass; null for a constant column."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[target, *by])
    wide = df.groupBy(*by).agg(*[correlation(c, target).alias(c) for c in cols])
    return wide.unpivot([*by], cols, "feature", "abs_corr").withColumn("abs_corr", F.abs("abs_corr"))


def top_correlations(df: DataFrame, target: str = "pm25", cols: Sequence[str] | None = None,
                     k: int = 12) -> DataFrame:
    return abs_correlations(df, target, cols).orderBy(F.desc_nulls_last("abs_corr"), "feature").limit(k)


def histogram(df: DataFrame, value: str, bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum; the last bin is closed."""
    by = list(by)
    rows = df.where(~missing(value)).select(*by, value)
    span = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_rows"))     # equal rows would get one salt
    if by:
        spread = salted_lookup(rows, span, by)
    else:
        spread = rows.join(F.broadcast(span))      # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))
    return (spread.withColumn("bin", F.when(width > 0, at).otherwise(F.lit(0)).cast("int"))
            .groupBy(*by, "bin").agg(
                F.sum("_rows").alias("n"),
                F.first(F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                F.first(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end")))


def dominant_category(df: DataFrame, value: str = "pm25", by: Sequence[str] = ()) -> DataFrame:
    """Most frequent band; of equally frequent ones the better band wins."""
    labelled = df.where(F.col(value).isNotNull())
    counts = category_distribution(labelled, value, by)
    # a NaN reading has the label of a missing one, which has no place among the bands
    rank = F.when(pm25_band_order("category") > 0, pm25_band_order("category")).otherwise(len(PM25_BANDS) + 1)
    return counts.groupBy(*by).agg(
        F.max_by("category", F.struct(F.col("n"), -rank)).alias("dominant"),
        F.max("n").alias("n"))


def family_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Feature columns and stored values per feature family."""
    filled = df.agg(*[F.count(c).alias(c) for c in cols])
    return (filled.unpivot([], list(cols), "feature", "filled")
            .groupBy(feature_family("feature").alias("family"))
            .agg(F.count(F.lit(1)).alias("n_features"), F.sum("filled").alias("n_values")))


# -- feature importance ---------------------------------------------------------------------
def importance_share(importance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share, family, rank and running share of every feature (a few rows per model)."""
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.desc("importance"), "feature")
    total = F.sum("importance").over(whole)
    return (importance
            .withColumn("pct", F.when(total != 0, F.col("importance") / total).otherwise(F.lit(0.0)))
            .withColumn("family", feature_family("feature"))
            .withColumn("rank", F.row_number().over(order))
            .withColumn("cumulative", F.sum("pct").over(order.rowsBetween(Window.unboundedPreceding, 0))))


def topk_coverage(shares: DataFrame, k: int = 12, by: Sequence[str] = ()) -> DataFrame:
    top = shares.where(F.col("rank") <= k)
    return top.groupBy(*by).agg(
        F.min_by("feature", "rank").alias("top_driver"), F.count(F.lit(1)).alias("k"),
        (F.sum("pct") * 100).alias("coverage_pct"))


def family_share(shares: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return shares.groupBy(*by, "family").agg(F.sum("pct").alias("share"))


def forecast_summary(forecast: DataFrame, by: Sequence[str] = (), value: str = "predicted_pm25") -> DataFrame:
    """Mean, peak and low of a forecast, bands of mean and peak, dominant band and window."""
    kpis = forecast.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_hours"), F.avg(value).alias("mean_value"),
        F.max(value).alias("max_value"), F.min(value).alias("min_value"),
        F.min("datetime").alias("first_hour"), F.max("datetime").alias("last_hour"))
    kpis = kpis.withColumns({"mean_category": pm25_category("mean_value"),
                             "peak_category": pm25_category("max_value")})
    mode = dominant_category(forecast, value, by).drop("n")
    return kpis.join(mode, [*by]) if by else kpis.join(F.broadcast(mode))

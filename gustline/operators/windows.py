"""Lag and rolling features in the three definitions of :class:`gustline.spec.FeatureSpec`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions.clock import add_time_features
from gustline.operators.blocks import BLOCK_ROWS, IDX, Ordered, ordered, ordered_by_time
from gustline.spec import FeatureSpec


def _lag(spec: FeatureSpec, view: Ordered, n: int) -> Column:
    value = F.lag(spec.target, n).over(view.window)
    if spec.mode != "expanding_past":
        return value
    return F.when(F.col(IDX) > n, value).otherwise(F.lag(spec.target, 1).over(view.window))


def _mean(spec: FeatureSpec, view: Ordered, n: int) -> Column:
    if spec.mode == "inclusive":
        return F.avg(spec.target).over(view.rows(-(n - 1), 0))
    frame = view.rows(-n, -1)
    value = F.avg(spec.target).over(frame)
    if spec.mode == "strict":
        # avg skips nulls and accepts short windows, a full window is asked for here
        return F.when(F.count(spec.target).over(frame) == n, value)
    return value


def _std(spec: FeatureSpec, view: Ordered, n: int) -> Column:
    if spec.mode == "inclusive":
        return F.coalesce(F.stddev_samp(spec.target).over(view.rows(-(n - 1), 0)), F.lit(0.0))
    frame = view.rows(-n, -1)
    value = F.stddev_samp(spec.target).over(frame)
    seen = F.count(spec.target).over(frame)
    if spec.mode == "strict":
        return F.when(seen == n, value)
    return F.when(seen >= 1, F.coalesce(value, F.lit(0.0)))


def window_columns(view: Ordered, spec: FeatureSpec) -> dict[str, Column]:
    """All features of a specification over one window, so that Spark sorts once."""
    lag, mean, std = spec.prefixes
    return {**{f"{lag}{n}": _lag(spec, view, n) for n in spec.lags},
            **{f"{mean}{n}": _mean(spec, view, n) for n in spec.means},
            **{f"{std}{n}": _std(spec, view, n) for n in spec.stds}}


def add_window_features(df: DataFrame, spec: FeatureSpec, series_cols: Sequence[str],
                        order_cols: Sequence[str] = ("datetime",),
                        buckets: Sequence[Column] | None = None,
                        block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Lags, rolling means and rolling standard deviations of ``spec``, row based."""
    view = ordered(df, series_cols, spec.lookback, order_cols, buckets, block_rows)
    view.df = view.df.withColumns(window_columns(view, spec))
    return view.finish()


def add_timed_features(df: DataFrame, spec: FeatureSpec, series_cols: Sequence[str],
                       ts: str = "datetime") -> DataFrame:
    """The strict features by clock time: lag n is the value n hours ago, whatever rows lie
    between; a missing hour gives null, and a rolling mean is null unless all hours are there."""
    view = ordered_by_time(df, series_cols, spec.lookback, ts)
    lag, mean, std = spec.prefixes
    y = spec.target

    def whole(n: int, value: Column) -> Column:
        return F.when(F.count(y).over(view.window.rangeBetween(-n, -1)) == n, value)

    view.df = view.df.withColumns({
        **{f"{lag}{n}": F.max(y).over(view.window.rangeBetween(-n, -n)) for n in spec.lags},
        **{f"{mean}{n}": whole(n, F.avg(y).over(view.window.rangeBetween(-n, -1))) for n in spec.means},
        **{f"{std}{n}": whole(n, F.stddev_samp(y).over(view.window.rangeBetween(-n, -1))) for n in spec.stds},
    })
    return view.finish().drop("_hour")


def trailing_mean(df: DataFrame, col: str, n: int, name: str, series_cols: Sequence[str],
                  block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Mean of the current and the n - 1 rows before it, null until the window is full."""
    view = ordered(df, series_cols, n, block_rows=block_rows)
    frame = view.rows(-(n - 1), 0)
    view.df = view.df.withColumn(name, F.when(F.count(col).over(frame) == n, F.avg(col).over(frame)))
    return view.finish()


def build_features(df: DataFrame, spec: FeatureSpec, series_cols: Sequence[str],
                   block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Lags, rolls and calendar columns, without the warm-up rows."""
    return add_time_features(add_window_features(df, spec, series_cols, block_rows=block_rows)).na.drop("any")


def recompute_features(df: DataFrame, series_cols: Sequence[str], columns: Sequence[str] | None = None,
                       target: str = "pm25", block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Bring a feature table up to date by the specification its own column names hold."""
    spec = FeatureSpec.from_columns(list(columns or df.columns), target)
    layout = df.columns
    fresh = add_window_features(df.drop(*spec.columns), spec, series_cols, block_rows=block_rows)
    fresh = add_time_features(fresh)
    return fresh.select(*layout, *[c for c in fresh.columns if c not in layout])


def out_of_order(df: DataFrame, arrival_cols: Sequence[str], ts: str, series_cols: Sequence[str],
                 buckets: Sequence[Column]) -> DataFrame:
    """Rows whose time is not after that of the row that arrived before them, per series."""
    view = ordered(df, series_cols, 1, arrival_cols, buckets)
    view.df = view.df.withColumn("_late", F.lag(ts).over(view.window) >= F.col(ts))
    return (view.finish().groupBy(*series_cols)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_late").alias("n_out_of_order")))

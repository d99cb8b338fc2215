"""Joining feeds and bringing new hours into a feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.operators.blocks import fill_forward, null_safe_join, salted_lookup, with_row_index
from gustline.operators.splits import latest_row


def merge_feeds(a: DataFrame, b: DataFrame, series_cols: Sequence[str], ts: str = "datetime") -> DataFrame:
    """Inner join of two feeds on series and hour.

    Both sides hold one row per key, so the join neither grows nor has a hot key.
    """
    return null_safe_join(a, b, [*series_cols, ts])


def carry_forward(existing: DataFrame, new: DataFrame, base_cols: Sequence[str],
                  series_cols: Sequence[str], ts: str = "datetime") -> DataFrame:
    """New rows whose missing readings take the value before them.

    Earlier new rows come first, then the last stored row of the series (its own value, even
    if that is null). The stored history itself is only reduced to one row per series.
    """
    last = latest_row(existing.select(*series_cols, ts, *base_cols), series_cols, ts)
    stored = last.select(*series_cols, *[F.col(c).alias(f"_stored_{c}") for c in base_cols])
    filled = fill_forward(new, base_cols, series_cols, ts)
    return (salted_lookup(filled, stored, [*series_cols], how="left")
            .withColumns({c: F.coalesce(F.col(c), F.col(f"_stored_{c}")) for c in base_cols})
            .select(*new.columns))


def future_horizon(feed: DataFrame, history: DataFrame, series_cols: Sequence[str],
                   horizon: int = 72, ts: str = "datetime") -> DataFrame:
    """The first ``horizon`` rows of a feed strictly after the last known hour, with ``step``."""
    last = history.groupBy(*series_cols).agg(F.max(ts).alias("_last"))
    later = salted_lookup(feed, last, [*series_cols]).where(F.col(ts) > F.col("_last")).drop("_last")
    return (with_row_index(later, series_cols, (ts,)).where(F.col("_idx") <= horizon)
            .withColumnRenamed("_idx", "step").drop("_n"))


def future_grid(df: DataFrame, series_cols: Sequence[str], periods: int = 168, ts: str = "datetime") -> DataFrame:
    """The hours after the last one of every series."""
    last = df.groupBy(*series_cols).agg(F.max(ts).alias("_last"))
    hours = F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: F.struct(
        i.alias("step"), (F.col("_last") + F.make_interval(hours=i)).cast("timestamp_ntz").alias(ts)))
    return last.select(*series_cols, F.inline(hours))


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None,
         name: str = "series_name", value: str = "value") -> DataFrame:
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    return df.unpivot([*ids], cols, name, value)

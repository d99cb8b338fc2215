"""Exact order statistics of large groups: cumulated counts, quantiles.

Sorting a whole group in one task does not scale, so the value axis of a group is cut into cells
at approximate quantiles of its distinct values. The borders only say how the work is
split, the results stay exact: counts per cell give each cell its offset, and rows are ordered inside
their cell. Whatever the spread of the values, cells hold nearly equal numbers of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.operators.blocks import null_safe_join, salted_lookup
from gustline.session import materialise

CELLS = 128


def _lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    if bounded:     # at most (bounded keys) x CELLS rows
        return null_safe_join(df, F.broadcast(table), keys)
    return salted_lookup(df, table, keys)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weights: dict[str, Column]) -> DataFrame:
    """Distinct values per group with summed weights; nulls and NaN are left out.

    Repeated values are counted before the shuffle, and distinct ones spread over all tasks.
    """
    counts = (df.where(F.col(value).isNotNull() & ~F.isnan(value))
              .groupBy(*keys, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()]))
    return materialise(counts, "value-counts")      # every level of cells reads it again


def in_cells(counts: DataFrame, keys: Sequence[str], value: str, bounded_keys: bool = False) -> DataFrame:
    """Adds ``_cell``, a monotone function of the value whose cells hold nearly equal numbers of values."""
    parts = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    borders = counts.groupBy(*keys).agg(F.percentile_approx(value, parts, F.lit(20 * CELLS)).alias("_borders"))
    return (_lookup(counts, borders, keys, bounded_keys)
            .withColumn("_cell", F.size(F.filter("_borders", lambda b: b < F.col(value)))).drop("_borders"))


def cumulate(counts: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str],
             bounded_keys: bool = False) -> DataFrame:
    """Add ``cum_<w>`` (weight up to and including the value) and ``total_<w>`` per group.

    ``bounded_keys`` says that the number of groups is fixed by the schema (features, hours of
    the day), so that the cell tables may be broadcast.
    """
    keys = list(keys)
    cells = in_cells(counts, keys, value, bounded_keys)
    path = ["_cell"]
    # one struct as the key, so that the join and the window share one shuffle
    cells = cells.withColumn("_key", F.struct(*keys, *path)).drop(*path)
    per_cell = cells.groupBy("_key").agg(*[F.sum(w).alias(f"_in_{w}") for w in weights])
    whole = Window.partitionBy(*[F.col("_key")[k] for k in keys])
    before = (whole.orderBy(*[F.col("_key")[c] for c in path])
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_cell.select(
        "_key",
        *[F.coalesce(F.sum(f"_in_{w}").over(before), F.lit(0)).alias(f"_before_{w}") for w in weights],
        *[F.sum(f"_in_{w}").over(whole).alias(f"total_{w}") for w in weights])
    inside = (Window.partitionBy("_key").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (cells.join(offsets, "_key")
            .withColumns({f"cum_{w}": F.sum(w).over(inside) + F.col(f"_before_{w}") for w in weights})
            .drop("_key", *[f"_before_{w}" for w in weights]))


def quantiles(cumulated: DataFrame, keys: Sequence[str], value: str, weight: str,
              probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles, one row per group with ``q`` as an array.

    Only the rows that hold one of the wanted positions leave the scan.
    """
    upto, n, w = F.col(f"cum_{weight}"), F.col(f"total_{weight}"), F.col(weight)
    levels = F.array(*[F.lit(float(p)) for p in probs])
    wanted = F.transform(levels, lambda p, i: F.struct(
        i.alias("i"), F.floor(p * (n - 1)).alias("lo"), F.ceil(p * (n - 1)).alias("hi"),
        (p * (n - 1) - F.floor(p * (n - 1))).alias("frac")))

    def here(index: Column) -> Column:
        return (index < upto) & (index >= upto - w)

    hits = cumulated.where(w > 0).select(
        *keys, F.col(value).alias("_v"), upto.alias("_upto"), w.alias("_w"),
        F.inline(F.filter(wanted, lambda s: here(s["lo"]) | here(s["hi"]))))
    inside = "(_upto > {0} AND {0} >= _upto - _w)"
    picked = hits.groupBy(*keys, "i").agg(
        F.expr(f"max(CASE WHEN {inside.format('lo')} THEN _v END) AS lo"),
        F.expr(f"max(CASE WHEN {inside.format('hi')} THEN _v END) AS hi"), F.max("frac").alias("frac"))
    point = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")
    return (picked.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("i", point.alias("v")))).alias("_q"))
            .select(*keys, F.col("_q.v").alias("q")))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    bounded_keys: bool = False) -> DataFrame:
    counts = value_counts(df, keys, value, {"w": F.lit(1)})
    return quantiles(cumulate(counts, keys, value, ["w"], bounded_keys), keys, value, "w", probs)

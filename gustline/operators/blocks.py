"""Row positions and bounded blocks of a series, without a task per series.

A window partitioned by the series alone puts a long series into one task. Here a series is
cut into blocks of a bounded number of rows; each block carries the last rows of the one
before it (a halo), so that a look-back of a few rows gives the same result as over the whole
series. Positions come from counts per (series, bucket), where a bucket is a coarse, monotone
function of the sort columns: the counts are small and give every bucket its offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gustline.functions.clock import month_floor

BLOCK_ROWS = 8192
IDX, SIZE = "_idx", "_n"
_BLOCK, _HALO, _KEY = "_block", "_halo", "_key"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets null keys meet; keeps the left side's key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def salted_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str], salts: int = 32,
                  how: str = "inner") -> DataFrame:
    """Join a table with one row per key to facts whose keys may be very uneven.

    Facts get a salt from their own content and the lookup one copy per salt, so a hot key is
    spread over ``salts`` tasks.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return null_safe_join(df.withColumn("_salt", salt), lookup.withColumn("_salt", copies),
                          [*keys, "_salt"], how).drop("_salt")


def with_row_index(df: DataFrame, series_cols: Sequence[str], order_cols: Sequence[str] = ("datetime",),
                   buckets: Sequence[Column] | None = None, totals: dict[str, Column] | None = None
                   ) -> DataFrame:
    """Add ``_idx`` (1, 2, … in order within the series) and ``_n`` (rows of the series).

    ``buckets`` must be monotone in the sort order, most significant first; the default is the
    month of the first sort column. ``totals`` adds sums over the whole series, from the same
    pass. The order must be total within a series.
    """
    buckets = list(buckets) if buckets is not None else [month_floor(order_cols[0])]
    names = [f"_bucket{i}" for i in range(len(buckets))]
    totals = totals or {}
    # one struct as the key: nulls in it are equal to each other, and the join and the window
    # below ask for the same partitioning, so that rows are shuffled once
    marked = df.withColumn(_KEY, F.struct(*series_cols, *[b.alias(n) for b, n in zip(buckets, names)]))
    counts = marked.groupBy(_KEY).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(e).alias(f"_part_{k}") for k, e in totals.items()])
    whole = Window.partitionBy(*[F.col(_KEY)[c] for c in series_cols])
    before = whole.orderBy(*[F.col(_KEY)[n] for n in names]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _KEY, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias(SIZE),
        *[F.sum(f"_part_{k}").over(whole).alias(k) for k in totals])
    inside = Window.partitionBy(_KEY).orderBy(*order_cols)
    return (marked.join(offsets, _KEY)
            .withColumn(IDX, F.row_number().over(inside) + F.col("_before"))
            .drop("_before", _KEY))


@dataclass
class Ordered:
    """A frame whose ``window`` sees ``lookback`` rows back from every row that is kept."""

    df: DataFrame
    window: WindowSpec

    def rows(self, back: int, ahead: int = 0) -> WindowSpec:
        return self.window.rowsBetween(back, ahead)

    def finish(self, keep: Sequence[str] = ()) -> DataFrame:
        """Drop the halo rows and the helper columns, but for those in ``keep``."""
        out = self.df
        if _HALO in out.columns:
            out = out.where(~F.col(_HALO))
        return out.drop(*[c for c in (_BLOCK, _HALO, IDX, SIZE) if c not in keep])


def ordered(df: DataFrame, series_cols: Sequence[str], lookback: int,
            order_cols: Sequence[str] = ("datetime",), buckets: Sequence[Column] | None = None,
            block_rows: int | None = BLOCK_ROWS) -> Ordered:
    """Frame and window for row-based look-back.

    ``block_rows=None`` partitions by the series alone: one shuffle less, for series known to
    be short.
    """
    if block_rows is None:
        window = Window.partitionBy(*series_cols).orderBy(*order_cols)
        return Ordered(df.withColumn(IDX, F.row_number().over(window)), window)
    size = max(block_rows, lookback)
    at = F.col(IDX) - 1
    block = F.floor(at / F.lit(size))
    feeds_next = (F.pmod(at, F.lit(size)) >= size - lookback) & ((block + 1) * size < F.col(SIZE))
    own = F.struct(block.alias(_BLOCK), F.lit(False).alias(_HALO))
    ahead = F.struct((block + 1).alias(_BLOCK), F.lit(True).alias(_HALO))
    out = (with_row_index(df, series_cols, order_cols, buckets)
           .select("*", F.inline(F.when(feeds_next, F.array(own, ahead)).otherwise(F.array(own)))))
    return Ordered(out, Window.partitionBy(*series_cols, _BLOCK).orderBy(IDX))


def ordered_by_time(df: DataFrame, series_cols: Sequence[str], lookback_hours: int,
                    ts: str = "datetime", block_hours: int = BLOCK_ROWS) -> Ordered:
    """Frame and window for time-based look-back: order by ``_hour``, use ``rangeBetween``.

    Blocks and halo are functions of the time alone, so this needs a single shuffle.
    """
    size = max(block_hours, lookback_hours)
    hour = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600)
    block = F.floor(F.col("_hour") / F.lit(size))
    own = F.struct(block.alias(_BLOCK), F.lit(False).alias(_HALO))
    ahead = F.struct((block + 1).alias(_BLOCK), F.lit(True).alias(_HALO))
    feeds_next = F.pmod(F.col("_hour"), F.lit(size)) >= size - lookback_hours
    out = (df.withColumn("_hour", hour)
           .select("*", F.inline(F.when(feeds_next, F.array(own, ahead)).otherwise(F.array(own)))))
    return Ordered(out, Window.partitionBy(*series_cols, _BLOCK).orderBy("_hour"))


def fill_forward(df: DataFrame, cols: Sequence[str], series_cols: Sequence[str],
                 order_col: str = "datetime", bucket: Column | None = None) -> DataFrame:
    """Replace nulls by the last value before them in the series.

    The last value of every bucket is carried over the (few) buckets first, then rows are
    filled within their own bucket.
    """
    bucket = bucket if bucket is not None else month_floor(order_col)
    marked = df.withColumn(_KEY, F.struct(*series_cols, bucket.alias("_bucket")))
    last = marked.groupBy(_KEY).agg(
        *[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)),
                   F.when(F.col(c).isNotNull(), F.col(order_col))).alias(f"_last_{c}") for c in cols])
    along = (Window.partitionBy(*[F.col(_KEY)[c] for c in series_cols]).orderBy(F.col(_KEY)["_bucket"])
             .rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(_KEY, *[F.last(f"_last_{c}", ignorenulls=True).over(along).alias(f"_carry_{c}")
                                  for c in cols])
    inside = (Window.partitionBy(_KEY).orderBy(order_col)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")) for c in cols}
    return marked.join(carried, _KEY).withColumns(filled).drop(_KEY, *[f"_carry_{c}" for c in cols])

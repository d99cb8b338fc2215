"""Streaming ingest: hourly means, exactly-once hours, feature upserts and drift runs.

All sinks are keyed upserts or appends of whole batches, so a batch that is repeated after a
failure leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gustline.operators.blocks import null_safe_join, ordered, salted_lookup
from gustline.operators.drift import drift_against
from gustline.operators.windows import window_columns
from gustline.sources import key_filters, tables
from gustline.sources.tables import by_date, keep_last, path_exists, upsert_partitions
from gustline.spec import FeatureSpec


def hourly_means(readings: DataFrame, series_cols: Sequence[str], ts: str = "ts", value: str = "value",
                 watermark: str = "2 hours") -> DataFrame:
    """Tumbling hourly aggregation; state of hours behind the watermark is dropped."""
    hour = F.window(ts, "1 hour")
    # watermarks need a zoned type; the session time zone is UTC, so the clock stays the same
    return (readings.withColumn(ts, F.col(ts).cast("timestamp"))
            .withWatermark(ts, watermark).groupBy(hour, *series_cols)
            .agg(F.avg(value).alias("pm25"), F.max(value).alias("pm10"),
                 F.min(value).alias("co"), F.count(F.lit(1)).alias("n"))
            .select(*series_cols, F.col("window.start").cast("timestamp_ntz").alias("datetime"), "pm25", "pm10", "co", "n"))


def _start(stream: DataFrame, checkpoint: str, mode: str, batch: Callable[[DataFrame, int], None]
           ) -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(batch).start())


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str],
                  ts: str = "datetime", mode: str = "update") -> StreamingQuery:
    """Keep the newest state of every key in a table partitioned by date."""
    def batch(df: DataFrame, batch_id: int) -> None:
        upsert_partitions(df.withColumn("_batch", F.lit(batch_id).cast("bigint")), path, keys, ["_batch"], ts)

    return _start(stream, checkpoint, mode, batch)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_upserted(spark, path).drop("_batch", "date")


def stream_once(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str],
                ts: str = "datetime", part: str = "date") -> StreamingQuery:
    """Each key once in a table partitioned by date, however often and however late it is delivered.

    The row stored first stays. There is no watermark: every batch is compared with what is stored, by Bloom filters of the stored keys
    and then, only where these find a key, with the rows of its date. A batch that is repeated after a failure adds only
    what is not there yet.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        new = keep_last(df, keys, [c for c in df.columns if c not in keys]).withColumn(part, F.to_date(ts)).persist()
        fresh = new
        try:
            if path_exists(spark, path):
                key_filters.filtered(spark, path, keys, part)
                fresh = key_filters.unseen_filtered(new, path, keys, part).persist()
            key_filters.add_filters(fresh, path, keys, part)
            by_date(fresh, part).write.mode("append").partitionBy(part).parquet(path)
        finally:
            fresh.unpersist()
            new.unpersist()

    return _start(stream, checkpoint, "append", batch)


def stream_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", checkpoint).option("path", path)
            .trigger(availableNow=True).start())


def touched_features(base: DataFrame, new: DataFrame, spec: FeatureSpec, series_cols: Sequence[str],
                     ts: str = "datetime") -> DataFrame:
    """Features of the new rows and of the rows behind them that look back on them.

    ``base`` holds the new rows and, per series, at least the look-back before the first of
    them. A row is touched when it, or one of the ``lookback`` rows before it, is new.
    """
    keys = [*series_cols, ts]
    marks = new.select(*keys, F.lit(True).alias("_new"))
    view = ordered(null_safe_join(base, marks, keys, "left"), series_cols, spec.lookback, (ts,))
    near_new = F.count("_new").over(view.rows(-spec.lookback, 0)) > 0
    view.df = view.df.withColumns({**window_columns(view, spec), "_touched": near_new})
    return view.finish().where("_touched").drop("_new", "_touched")


def affected_history(base: DataFrame, new: DataFrame, lookback: int, series_cols: Sequence[str],
                     ts: str = "datetime", part: str = "date") -> DataFrame:
    """The part of a table that new rows can touch: for each of their series, from the day that holds
    the ``lookback``-th row before its first new hour.

    Rows per series and day (counted from two narrow columns) say which day that is, so a series
    with gaps reaches further back and no series makes another one read more.
    """
    starts = new.groupBy(*series_cols).agg(F.min(ts).alias("_first"))
    days = base.groupBy(*series_cols, part).agg(F.count(F.lit(1)).alias("_rows"))
    older = null_safe_join(days, starts, series_cols).where(F.col(part) < F.to_date("_first"))
    back = (Window.partitionBy(*series_cols).orderBy(F.desc(part))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))     # one row per day
    enough = older.withColumn("_reach", F.sum("_rows").over(back)).where(F.col("_reach") >= lookback)
    since = enough.groupBy(*series_cols).agg(F.max(part).alias("_since"))
    wanted = null_safe_join(starts.select(*series_cols), since, series_cols, "left")
    found = salted_lookup(base, wanted, series_cols)
    return found.where(F.col("_since").isNull() | F.col(part).isNull() | (F.col(part) >= F.col("_since"))).drop("_since")


def stream_features(stream: DataFrame, base_path: str, feature_path: str, checkpoint: str, spec: FeatureSpec,
                    series_cols: Sequence[str], ts: str = "datetime") -> StreamingQuery:
    """Upsert new hours, then recompute only the features they touch; late hours included."""
    keys = [*series_cols, ts]

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        new = df.withColumn("_batch", F.lit(batch_id).cast("bigint"))
        new = keep_last(new, keys, ["_batch", *[c for c in df.columns if c not in keys]]).persist()
        try:
            upsert_partitions(new, base_path, keys, ["_batch"], ts)
            base = affected_history(tables.read_upserted(spark, base_path), new, spec.lookback, series_cols, ts)
            fresh = touched_features(base.drop("_batch", "date"), new, spec, series_cols, ts)
            upsert_partitions(fresh.withColumn("_batch", F.lit(batch_id).cast("bigint")),
                              feature_path, keys, ["_batch"], ts)
        finally:
            new.unpersist()

    return _start(stream, checkpoint, "append", batch)


def stream_drift(stream: DataFrame, reference: str, path: str, checkpoint: str, cols: Sequence[str],
                 series_cols: Sequence[str] = ()) -> StreamingQuery:
    """A drift report of every batch against a stored reference (``drift.save_reference``), appended to the run history.

    The rows of the reference are not read again. The run is stored under its batch number: a repeated batch replaces its own run.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        found = drift_against(df.sparkSession, reference, df, cols, series_cols)
        found.withColumn("run", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(stream, checkpoint, "append", batch)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/batch=*")

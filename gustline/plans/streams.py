"""Streaming queries: the given events go through a stream, the result equals the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.operators import drift
from gustline.plans.features import rounded
from gustline.plans.frames import CUT, SERIES, Query, hourly, sql, table
from gustline.plans.monitoring import samples_cte
from gustline.session import shared_dir
from gustline.spec import FeatureSpec
from gustline.streaming import hourly as streams
from gustline.streaming.online import online_features

KEYS = [*SERIES, "datetime"]
FILES_PER_BATCH = 100
STREAM_SPEC = FeatureSpec(lags=(1, 24), means=(6, 24))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("series", F.col("event_type"))


def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    base = shared_dir(spark, "stream-hourly")
    means = streams.hourly_means(_events(spark, sf), SERIES)
    streams.stream_upsert(means, f"{base}/table", f"{base}/checkpoint", KEYS).awaitTermination()
    return streams.read_upserted(spark, f"{base}/table").withColumn("pm25", F.round("pm25", 6))


def _drop(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


def _stream(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    # a long backlog comes in several micro-batches
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(folder)


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every hour is delivered several times, some of them late or long after they were stored, and arrives once."""
    base = shared_dir(spark, "stream-dedupe")
    rows = hourly(spark, sf)
    late = F.dayofmonth("datetime") % 9 == 4
    for part in (rows.where(~late).unionByName(rows.where(~late)), rows, rows.where(late)):
        _drop(part, f"{base}/in")
        streams.stream_once(_stream(spark, rows, f"{base}/in"), f"{base}/out", f"{base}/checkpoint", KEYS).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*rows.columns)


def _two_deliveries(spark: SparkSession, sf: str, base: str, run) -> None:
    """Deliver the hours before the cut, run, deliver the rest, run again on the same state."""
    rows = hourly(spark, sf).select(*KEYS, "pm25")
    early = F.col("datetime") < F.lit(CUT).cast("timestamp_ntz")
    for part in (early, ~early):
        _drop(rows.where(part), f"{base}/in")
        run(_stream(spark, rows, f"{base}/in")).awaitTermination()


def stream_online_features(spark: SparkSession, sf: str) -> DataFrame:
    base = shared_dir(spark, "stream-online")
    _two_deliveries(spark, sf, base, lambda s: streams.stream_append(
        online_features(s, STREAM_SPEC, SERIES), f"{base}/out", f"{base}/checkpoint"))
    out = spark.read.parquet(f"{base}/out")
    return rounded(out, [c for c in STREAM_SPEC.columns if "roll" in c])


def stream_feature_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The second delivery holds hours that are late: the features behind them change too."""
    base = shared_dir(spark, "stream-features")
    rows = hourly(spark, sf).select(*KEYS, "pm25")
    late = F.dayofmonth("datetime") % 9 == 4
    for part in (~late, late):
        _drop(rows.where(part), f"{base}/in")
        streams.stream_features(_stream(spark, rows, f"{base}/in"), f"{base}/base", f"{base}/features",
                                f"{base}/checkpoint", STREAM_SPEC, SERIES).awaitTermination()
    out = streams.read_upserted(spark, f"{base}/features")
    return rounded(out, [c for c in STREAM_SPEC.columns if "roll" in c])


DELIVERED = ["2024-01-16 00:00:00", "2024-01-20 00:00:00", "2024-01-25 00:00:00", "2024-03-01 00:00:00"]
WATCHED = ["pm25", "pm10", "co"]


def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Three deliveries, each against the stored statistics of the hours of the first half of the month."""
    base = shared_dir(spark, "stream-drift")
    rows = hourly(spark, sf)
    at = [F.lit(x).cast("timestamp_ntz") for x in DELIVERED]
    # two samples whose counts are put together
    parts = [rows.where((F.col("datetime") < at[0]) & (F.dayofmonth("datetime") % 2 == odd)) for odd in (0, 1)]
    drift.save_reference(drift.merged_counts(*[drift.reference_counts(p, WATCHED) for p in parts]), f"{base}/reference")
    for first, last in zip(at, at[1:]):
        _drop(rows.where((F.col("datetime") >= first) & (F.col("datetime") < last)), f"{base}/in")
        streams.stream_drift(_stream(spark, rows, f"{base}/in"), f"{base}/reference", f"{base}/runs", f"{base}/checkpoint",
                             WATCHED).awaitTermination()
    return streams.read_runs(spark, f"{base}/runs").select("run", "feature", "n_ref", "n_rec", F.round("d", 9).alias("d"),
                                                           "p_asymptotic", "psi", "status")


_ROLL = ", ".join(
    f"CASE WHEN count(pm25) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN "
    f"round(avg(pm25) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 8) END AS pm25_roll_mean_{n}" for n in (6, 24))
_FEATS = f"series, datetime, pm25, lag(pm25, 1) OVER w AS pm25_lag_1, lag(pm25, 24) OVER w AS pm25_lag_24, {_ROLL}"
_W = "WINDOW w AS (PARTITION BY series ORDER BY datetime)"

QUERIES = [
    Query("stream_hourly", stream_hourly, """
        SELECT event_type AS series, date_trunc('hour', ts) AS datetime, round(avg(value), 6) AS pm25, max(value) AS pm10,
        min(value) AS co, count(*) AS n FROM events GROUP BY 1, 2"""),
    Query("stream_dedupe", stream_dedupe, sql("hourly", "SELECT * FROM hourly")),
    Query("stream_online_features", stream_online_features, sql("hourly", f"SELECT {_FEATS}, false AS late FROM hourly {_W}")),
    Query("stream_feature_upsert", stream_feature_upsert, sql("hourly", f"SELECT {_FEATS} FROM hourly {_W}")),
    Query("stream_drift", stream_drift, sql("hourly", """,
        samples AS (""" + " UNION ALL ".join(
        f"""SELECT {run} AS run, CASE WHEN datetime < TIMESTAMP '{DELIVERED[0]}' THEN 'reference' ELSE 'recent' END AS role, pm25, pm10, co
        FROM hourly WHERE datetime < TIMESTAMP '{DELIVERED[0]}'
        OR (datetime >= TIMESTAMP '{DELIVERED[run]}' AND datetime < TIMESTAMP '{DELIVERED[run + 1]}')""" for run in range(3)) + ")"
        + samples_cte("run, ", WATCHED) + """
        SELECT run, feature, n_ref, n_rec, round(d, 9) AS d, round(p, 6) AS p_asymptotic, psi,
        CASE WHEN p < 0.05 AND psi >= 0.2 THEN 'DRIFT' WHEN p < 0.05 OR psi >= 0.1 THEN 'WARNING' ELSE 'NORMAL' END AS status
        FROM asym JOIN psis USING (run, feature)""")),
]

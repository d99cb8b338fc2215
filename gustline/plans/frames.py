"""Frames the queries start from, all derived from the given tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions.clock import add_time_features, hour_floor
from gustline.operators.feeds import merge_feeds
from gustline.operators.splits import split_recent
from gustline.operators.windows import add_window_features
from gustline.session import materialise
from gustline.spec import FeatureSpec

SERIES = ["series"]
DIGITS = 8      # of rolling features: equal windows give equal values, whatever the order of the sum
SPEC = FeatureSpec()
MODEL_FEATURES = ["pm10", "co", "temperature", "humidity", "pm25_lag_1", "pm25_lag_3", "pm25_lag_6",
                  "pm25_lag_12", "pm25_lag_24", "pm25_roll_mean_6", "pm25_roll_mean_12",
                  "pm25_roll_mean_24", "hour", "day_of_week", "day", "hour_sin", "hour_cos"]
DRIFT_FEATURES = ["pm10", "co", "temperature", "humidity", "pm25_lag_1", "pm25_roll_mean_6", "hour"]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """The pollutant side: one row per event type and hour.

    The sum is taken over decimals: it is exact and does not depend on the order of the rows.
    """
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("series"), hour_floor("ts").alias("datetime"), "value")
    return events.groupBy("series", "datetime").agg(
        (F.sum(F.col("value").cast("decimal(20,6)")).cast("double") / F.count(F.lit(1))).alias("pm25"), F.max("value").alias("pm10"),
        F.min("value").alias("co"), F.count(F.lit(1)).alias("n"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """The second feed; hour 3 is missing, so that the inner join drops rows."""
    k = F.get_json_object("props", "$.k").cast("double")
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("series"), hour_floor("ts").alias("datetime"), k.alias("k"))
    return (events.where(F.hour("datetime") != 3).groupBy("series", "datetime")
            .agg(F.avg("k").alias("temperature"), F.max("k").alias("humidity")))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge_feeds(hourly(spark, sf), weather(spark, sf), SERIES)


def stored_hours(spark: SparkSession, sf: str) -> DataFrame:
    """The joined feeds as written: far smaller than the events, and read more than once."""
    return materialise(merged(spark, sf), "hours")


def features(spark: SparkSession, sf: str, spec: FeatureSpec = SPEC) -> DataFrame:
    """The feature table, warm-up rows dropped; derived columns rounded so that equal values
    stay equal whatever the order of the additions."""
    df = add_time_features(add_window_features(stored_hours(spark, sf), spec, SERIES))
    noisy = [c for c in spec.columns if "roll" in c] + ["hour_sin", "hour_cos"]
    return df.withColumns({c: F.round(c, DIGITS) for c in noisy}).na.drop("any")


def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table as written: splits, training and monitoring read it more than once."""
    return materialise(features(spark, sf), "features")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return split_recent(stored_features(spark, sf), SERIES)


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """The pollutant side with duplicates, nulls, negatives, an empty and a sparse column."""
    h = hourly(spark, sf)
    bad = h.withColumns({
        "pm10": F.when(F.hour("datetime") != 7, F.col("pm10")),
        "co": F.when(F.hour("datetime") == 5, -F.col("co")).otherwise(F.col("co")),
        "no2": F.lit(None).cast("double"),
        "aod": F.when(F.hour("datetime") < 4, F.col("pm25")),
    })
    return bad.unionByName(bad.where(F.col("n") >= 2))


# Cut between stored and fetched hours, and between history and future.
CUT = "2024-01-25 00:00:00"


def existing(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).where(F.col("datetime") < F.lit(CUT).cast("timestamp_ntz"))


def stored_existing(spark: SparkSession, sf: str) -> DataFrame:
    """The hours before the cut as written, for queries that read them more than once."""
    return materialise(existing(spark, sf), "existing")


def existing_and_fetched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored and fetched hours, which overlap, from one pass over the events."""
    hours = materialise(hourly(spark, sf), "hourly")
    return (hours.where(F.col("datetime") < F.lit(CUT).cast("timestamp_ntz")),
            hours.where(F.col("datetime") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")))


# -- the same frames in SQL -----------------------------------------------------------------
def _feature_sql() -> str:
    lags = ", ".join(f"lag(pm25, {n}) OVER w AS pm25_lag_{n}" for n in SPEC.lags)
    rolls = ", ".join(
        f"CASE WHEN count(pm25) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} "
        f"THEN round(avg(pm25) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 8) END AS pm25_roll_mean_{n}"
        for n in SPEC.means)
    calendar = ("CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week, "
                "CAST(month(datetime) AS INTEGER) AS month, CAST(day(datetime) AS INTEGER) AS day, "
                "round(sin(2 * pi() * hour(datetime) / 24), 8) + 0.0 AS hour_sin, "
                "round(cos(2 * pi() * hour(datetime) / 24), 8) + 0.0 AS hour_cos")
    return (f"SELECT * FROM (SELECT *, {lags}, {rolls}, {calendar} FROM merged "
            f"WINDOW w AS (PARTITION BY series ORDER BY datetime)) "
            f"WHERE pm25_lag_24 IS NOT NULL AND pm25_roll_mean_24 IS NOT NULL")


_CTES: dict[str, tuple[list[str], str]] = {
    "hourly": ([], """SELECT event_type AS series, date_trunc('hour', ts) AS datetime,
        CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS pm25, max(value) AS pm10, min(value) AS co, count(*) AS n
        FROM events GROUP BY 1, 2"""),
    "weather": ([], """SELECT event_type AS series, date_trunc('hour', ts) AS datetime,
        avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS temperature,
        max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS humidity
        FROM events WHERE hour(ts) <> 3 GROUP BY 1, 2"""),
    "merged": (["hourly", "weather"], "SELECT * FROM hourly JOIN weather USING (series, datetime)"),
    "features": (["merged"], _feature_sql()),
    "positions": (["features"], """SELECT *, row_number() OVER (PARTITION BY series ORDER BY datetime) AS idx,
        count(*) OVER (PARTITION BY series) AS size FROM features"""),
    "samples": (["positions"], """SELECT * EXCLUDE (idx, size),
        CASE WHEN idx > size - 72 THEN 'recent' ELSE 'reference' END AS role FROM positions"""),
    "held": (["positions"], """SELECT *,
        greatest(CAST(floor(CAST(0.15 AS DOUBLE) * size) AS BIGINT), 24) AS test_size FROM positions"""),
    "dev": (["held"], """SELECT * EXCLUDE (size), size - test_size AS size FROM held
        WHERE idx <= size - test_size"""),
    "folds": (["dev"], """SELECT * FROM (SELECT dev.*, CAST(f AS INTEGER) AS fold,
        CASE WHEN idx <= size - (4 - f) * (size // 4) THEN 'train'
             WHEN idx <= size - (3 - f) * (size // 4) THEN 'val' END AS role
        FROM dev, range(1, 4) t(f)) WHERE role IS NOT NULL"""),
    "bad": (["hourly"], """SELECT series, datetime, pm25,
        CASE WHEN hour(datetime) <> 7 THEN pm10 END AS pm10,
        CASE WHEN hour(datetime) = 5 THEN -co ELSE co END AS co, n, CAST(NULL AS DOUBLE) AS no2,
        CASE WHEN hour(datetime) < 4 THEN pm25 END AS aod FROM hourly"""),
    "dirty": (["bad"], "SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE n >= 2"),
    "existing": (["hourly"], f"SELECT * FROM hourly WHERE datetime < TIMESTAMP '{CUT}'"),
    "fetched": (["hourly"], "SELECT * FROM hourly WHERE datetime >= TIMESTAMP '2024-01-24 00:00:00'"),
}


def add_cte(name: str, needs: list[str], body: str) -> None:
    _CTES[name] = (needs, body)


def sql(needs: str, body: str) -> str:
    """``body`` behind the named common table expressions and those they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _CTES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + body

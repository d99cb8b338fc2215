"""Queries over lags, rolling windows, calendar columns and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions.bands import pm25_category
from gustline.functions.clock import add_time_features
from gustline.operators import splits
from gustline.operators.clean import validate
from gustline.operators.feeds import merge_feeds
from gustline.operators.windows import (add_timed_features, add_window_features, build_features,
                                        recompute_features, trailing_mean)
from gustline.plans.frames import (DIGITS, SERIES, SPEC, Query, features, hourly, merged, sql, stored_hours,
                                    stored_features, table, weather)
from gustline.session import materialise
from gustline.spec import FORECAST_SPEC, FeatureSpec

KEYS = [*SERIES, "datetime"]


def rounded(df: DataFrame, cols: list[str], digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: hourly means, validation, join, features, warm-up dropped, band."""
    clean = materialise(merge_feeds(validate(hourly(spark, sf)), validate(weather(spark, sf)), SERIES), "hours")
    out = build_features(clean, SPEC, SERIES).withColumn("category", pm25_category("pm25"))
    return rounded(out, [c for c in SPEC.columns if "roll" in c] + ["hour_sin", "hour_cos"])


def _window(df: DataFrame, spec: FeatureSpec, cols: list[str]) -> DataFrame:
    return rounded(add_window_features(df, spec, SERIES).select(*KEYS, *cols), [c for c in cols if "roll" in c])


def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    spec = FeatureSpec(means=())
    return _window(stored_hours(spark, sf), spec, spec.columns)


def roll_mean_strict(spark: SparkSession, sf: str) -> DataFrame:
    spec = FeatureSpec(lags=())
    return _window(stored_hours(spark, sf), spec, spec.columns)


def roll_mean_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    spec = FeatureSpec(lags=(), means=(3, 6, 12, 24), mode="inclusive")
    return _window(stored_hours(spark, sf), spec, spec.columns)


def roll_std_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    spec = FeatureSpec(lags=(), means=(), stds=(3, 6, 12, 24), mode="inclusive")
    return _window(stored_hours(spark, sf), spec, spec.columns)


def roll_past_expanding(spark: SparkSession, sf: str) -> DataFrame:
    return _window(stored_hours(spark, sf), FORECAST_SPEC, FORECAST_SPEC.columns)


def recompute_layout(spark: SparkSession, sf: str) -> DataFrame:
    """A feature table brought up to date by its own column names (rolls include the row)."""
    out = recompute_features(features(spark, sf), SERIES)
    noisy = [c for c in SPEC.columns if "roll" in c]
    return rounded(out.select(*KEYS, *SPEC.columns, "hour", "day_of_week"), noisy)


def timed_features(spark: SparkSession, sf: str) -> DataFrame:
    spec = FeatureSpec(lags=(1, 24), means=(3, 6))
    out = add_timed_features(merged(spark, sf), spec, SERIES)
    return rounded(out.select(*KEYS, *spec.columns), [c for c in spec.columns if "roll" in c])


def trend_roll6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trailing_mean(hourly(spark, sf), "pm25", 6, "trend", SERIES).select(*KEYS, "trend"), ["trend"])


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def long_series_features(spark: SparkSession, sf: str) -> DataFrame:
    """Look-back over a few very long series: line items per return flag in shipping order."""
    spec = FeatureSpec(target="l_quantity", lags=(1, 24), means=(24,))
    lines = table(spark, sf, "lineitem").select("l_returnflag", *LINE_ORDER)
    buckets = [F.col("l_shipdate"), F.floor(F.col("l_orderkey") / F.lit(1 << 30))]
    out = add_window_features(lines, spec, ["l_returnflag"], LINE_ORDER, buckets)
    return rounded(out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                              "l_extendedprice", *spec.columns), ["l_quantity_roll_mean_24"])


def time_features(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", F.col("ts").alias("datetime"))
    return rounded(add_time_features(ev), ["hour_sin", "hour_cos"])


def recent_vs_reference(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_recent(hourly(spark, sf), SERIES)


def enough_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.enough_rows(features(spark, sf), SERIES)


def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.holdout(stored_features(spark, sf), SERIES).select(*KEYS, "role")


def holdout_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return splits.holdout(stored_features(spark, sf), SERIES, fixed=splits.FIXED_HOLDOUT).select(*KEYS, "role")


def timeseries_folds(spark: SparkSession, sf: str) -> DataFrame:
    dev = splits.development(stored_features(spark, sf), SERIES)
    return splits.fold_summary(splits.ts_folds(dev, SERIES), SERIES)


# -- SQL ------------------------------------------------------------------------------------
_W = "WINDOW w AS (PARTITION BY series ORDER BY datetime)"


def _mean(n: int) -> str:
    f = f"w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"CASE WHEN count(pm25) OVER ({f}) = {n} THEN round(avg(pm25) OVER ({f}), 8) END AS pm25_roll_mean_{n}"


def _past(n: int) -> str:
    f = f"w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return (f"round(avg(pm25) OVER ({f}), 8) AS pm25_roll_mean_{n}, "
            f"CASE WHEN count(pm25) OVER ({f}) >= 1 THEN round(coalesce(stddev_samp(pm25) OVER ({f}), 0), 8) + 0.0 "
            f"END AS pm25_roll_std_{n}")


_LAGS = ", ".join(f"lag(pm25, {n}) OVER w AS pm25_lag_{n}" for n in (1, 3, 6, 12, 24))
_INCLUSIVE = ", ".join(f"round(avg(pm25) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 8) "
                       f"AS pm25_roll_mean_{n}" for n in (3, 6, 12, 24))
_STDS = ", ".join(f"round(coalesce(stddev_samp(pm25) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0), 8)"
                  f" + 0.0 AS pm25_roll_std_{n}" for n in (3, 6, 12, 24))
_EXPANDING = ", ".join([*(f"coalesce(lag(pm25, {n}) OVER w, lag(pm25, 1) OVER w) AS pm25_lag_{n}"
                          for n in (1, 3, 6, 12, 24)), *(_past(n) for n in (3, 6, 12, 24))])


def _timed(n: int) -> str:
    f = f"w RANGE BETWEEN INTERVAL {n} HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING"
    return f"CASE WHEN count(pm25) OVER ({f}) = {n} THEN round(avg(pm25) OVER ({f}), 8) END AS pm25_roll_mean_{n}"


_CALENDAR = ("CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week, "
             "CAST(month(datetime) AS INTEGER) AS month, CAST(day(datetime) AS INTEGER) AS day, "
             "round(sin(2 * pi() * hour(datetime) / 24), 8) + 0.0 AS hour_sin, "
             "round(cos(2 * pi() * hour(datetime) / 24), 8) + 0.0 AS hour_cos")

QUERIES = [
    Query("feature_table", feature_table, sql("features", """
        SELECT *, CASE WHEN pm25 >= 0 AND pm25 < 12 THEN 'Good' WHEN pm25 >= 12 AND pm25 < 35 THEN 'Moderate'
        WHEN pm25 >= 35 AND pm25 < 55 THEN 'Unhealthy (Sensitive)' WHEN pm25 >= 55 AND pm25 < 150 THEN 'Unhealthy'
        WHEN pm25 >= 150 AND pm25 < 250 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS category FROM features""")),
    Query("lag_features", lag_features, sql("merged", f"SELECT series, datetime, {_LAGS} FROM merged {_W}")),
    Query("roll_mean_strict", roll_mean_strict, sql(
        "merged", f"SELECT series, datetime, {', '.join(_mean(n) for n in (6, 12, 24))} FROM merged {_W}")),
    Query("roll_mean_inclusive", roll_mean_inclusive, sql("merged", f"SELECT series, datetime, {_INCLUSIVE} FROM merged {_W}")),
    Query("roll_std_inclusive", roll_std_inclusive, sql("merged", f"SELECT series, datetime, {_STDS} FROM merged {_W}")),
    Query("roll_past_expanding", roll_past_expanding, sql("merged", f"SELECT series, datetime, {_EXPANDING} FROM merged {_W}")),
    Query("recompute_layout", recompute_layout, sql("features", f"""
        SELECT series, datetime, {_LAGS}, {', '.join(
            f"round(avg(pm25) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 8) AS pm25_roll_mean_{n}"
            for n in (6, 12, 24))}, hour, day_of_week FROM features {_W}""")),
    Query("timed_features", timed_features, sql("merged", f"""
        SELECT series, datetime,
        max(pm25) OVER (w RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS pm25_lag_1,
        max(pm25) OVER (w RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING) AS pm25_lag_24,
        {_timed(3)}, {_timed(6)} FROM merged {_W}""")),
    Query("trend_roll6", trend_roll6, sql("hourly", f"""
        SELECT series, datetime, CASE WHEN count(pm25) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6
        THEN round(avg(pm25) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 8) END AS trend FROM hourly {_W}""")),
    Query("long_series_features", long_series_features, f"""
        SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        lag(l_quantity, 1) OVER w AS l_quantity_lag_1, lag(l_quantity, 24) OVER w AS l_quantity_lag_24,
        CASE WHEN count(l_quantity) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) = 24
        THEN round(avg(l_quantity) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 8) END AS l_quantity_roll_mean_24
        FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY {', '.join(LINE_ORDER)})"""),
    Query("time_features", time_features, f"""
        SELECT event_id, datetime, {_CALENDAR} FROM (SELECT event_id, ts AS datetime FROM events)"""),
    Query("recent_vs_reference", recent_vs_reference, sql("hourly", """
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY datetime DESC) <= 72
        THEN 'recent' ELSE 'reference' END AS role FROM hourly""")),
    Query("enough_rows", enough_rows, sql("features", """
        SELECT series, count(*) AS n_rows, count(*) > 82 AS enough FROM features GROUP BY 1""")),
    Query("holdout_split", holdout_split, sql("held", """
        SELECT series, datetime, CASE WHEN idx > size - test_size THEN 'test' ELSE 'dev' END AS role FROM held""")),
    Query("holdout_fixed", holdout_fixed, sql("positions", """
        SELECT series, datetime, CASE WHEN idx > size - 168 THEN 'test' ELSE 'dev' END AS role FROM positions""")),
    Query("timeseries_folds", timeseries_folds, sql("folds", """
        SELECT series, fold, role, count(*) AS n_rows, min(datetime) AS first_hour, max(datetime) AS last_hour
        FROM folds GROUP BY 1, 2, 3""")),
]

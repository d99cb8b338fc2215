"""Queries over sources, cleaning, joins and upserts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions.bands import band_table
from gustline.functions.clock import normalise_tz
from gustline.operators import clean, feeds
from gustline.operators.splits import latest_row
from gustline.operators.windows import out_of_order
from gustline.plans.frames import CUT, SERIES, Query, dirty, existing_and_fetched, features, hourly, merged, sql, table
from gustline.session import shared_dir
from gustline.sources import key_filters, payload, tables
from gustline.spec import Contract

FIELDS = {"pm2_5": "pm25", "pm10": "pm10", "carbon_monoxide": "co"}


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly payload text per series and day (at most 24 hours each)."""
    rows = F.array_sort(F.collect_list(F.struct(
        F.date_format("datetime", "yyyy-MM-dd'T'HH:mm").alias("time"),
        *[F.col(c).alias(f) for f, c in FIELDS.items()])))
    days = hourly(spark, sf).groupBy("series", F.to_date("datetime").alias("day")).agg(rows.alias("r"))
    hours = F.struct(*[F.col(f"r.{f}").alias(f) for f in ("time", *FIELDS)])
    return days.select("series", "day", F.to_json(F.struct(hours.alias("hourly"))).alias("text"))


def json_hourly_explode(spark: SparkSession, sf: str) -> DataFrame:
    parsed = payloads(spark, sf).select("series", payload.parse_payload(F.col("text"), FIELDS).alias("p"))
    return payload.explode_hourly(parsed.select("series", "p.hourly"), FIELDS, SERIES)


def payload_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("day") % 7
    broken = payloads(spark, sf).withColumn(
        "text", F.when(day == 0, F.substring("text", 1, 40))
        .when(day == 1, F.lit('{"error":true,"reason":"out of range"}'))
        .when(day == 2, F.lit('{"hourly":{"time":[]}}')).otherwise(F.col("text")))
    parsed = broken.select("series", "day", payload.parse_payload(F.col("text"), FIELDS).alias("p"))
    valid, refused = payload.split_quarantine(parsed, F.col("p"))
    both = valid.select("series", F.lit("valid").alias("reason")).unionByName(refused.select("series", "reason"))
    return both.groupBy("series", "reason").agg(F.count(F.lit(1)).alias("n"))


def json_nested_reading(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    v = lambda c: F.when(c.isNotNull(), F.struct(c.alias("v")))
    readings = table(spark, sf, "events").select("event_id", F.to_json(F.struct(
        F.when(F.col("event_id") % 11 == 0, "error").otherwise("ok").alias("status"),
        F.struct(F.when(F.col("event_id") % 5 != 0, F.floor(value)).alias("aqi"), F.struct(
            v(value).alias("pm25"), v(F.when(F.col("event_id") % 3 == 0, value * 2)).alias("pm10"),
        ).alias("iaqi")).alias("data"))).alias("text"))
    return payload.station_reading(readings, "text", ["event_id"]).select("event_id", "aqi", "pm25", "pm10", "no2")


def snapshot_pair(spark: SparkSession, sf: str) -> DataFrame:
    m = merged(spark, sf)
    station = m.select(*SERIES, "datetime", F.to_json(F.struct(F.lit("ok").alias("status"), F.struct(
        F.col("n").alias("aqi"), F.struct(F.struct(F.col("pm25").alias("v")).alias("pm25")).alias("iaqi")
    ).alias("data"))).alias("text"))
    now = m.where(F.hour("datetime") != 9).select(*SERIES, "datetime", F.to_json(F.struct(
        F.struct(F.col("temperature").alias("temp"), F.col("humidity")).alias("main"),
        F.struct(F.col("n").alias("all")).alias("clouds"))).alias("text"))
    keys = [*SERIES, "datetime"]
    return payload.snapshot_pair(
        payload.station_reading(station, "text", keys).select(*keys, "aqi", "pm25"),
        payload.weather_reading(now, "text", keys).select(*keys, "temperature", "humidity", "wind_speed", "clouds"),
        keys)


def date_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tables.date_range_scan(spark, f"{sf}/events.parquet", datetime(2024, 1, 5), datetime(2024, 1, 9, 12), "ts") \
        .select("event_id", "event_type", "value")


def snapshot_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Write snapshots by ingest date, read them back; newest file time as well."""
    path = shared_dir(spark, "snapshots")
    tables.save_snapshot(hourly(spark, sf), path)
    stored = spark.read.parquet(path).groupBy("ingest_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("pm25"), 6).alias("sum_pm25"))
    fresh = tables.freshness(spark, {"snapshots": path})
    return stored.join(F.broadcast(fresh.select(F.col("last_modified").isNotNull().alias("fresh"))))


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    existing, fetched = existing_and_fetched(spark, sf)
    old = existing.withColumn("ingest", F.lit(1))
    new = fetched.withColumn("pm25", F.col("pm25") + 1).withColumn("ingest", F.lit(2))
    return tables.upsert_latest(old, new, [*SERIES, "datetime"], ["ingest"])


def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Last event per series and hour, by time and id."""
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime"),
        "ts", "event_id", "value")
    return tables.restore(ev, [*SERIES, "datetime"], ["ts", "event_id"], [*SERIES, "datetime"])


def dedupe_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.preprocess(dirty(spark, sf).withColumnRenamed("pm25", "PM25")).drop("no2")


def tz_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("local"), normalise_tz("ts", "Asia/Karachi").alias("utc"))


def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return clean.profile(dirty(spark, sf)).select("column_name", "n_rows", "n_null",
                                                  F.round("null_ratio", 6).alias("null_ratio"))


def negative_profile(spark: SparkSession, sf: str) -> DataFrame:
    return clean.profile(dirty(spark, sf)).where(F.col("n_negative").isNotNull()).select("column_name", "n_negative")


def validate_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean.validate(dirty(spark, sf))


def dropna_subset(spark: SparkSession, sf: str) -> DataFrame:
    return dirty(spark, sf).na.drop("any", subset=["pm25", "pm10"]).select(*SERIES, "datetime", "pm25", "pm10", "co")


def contract_select(spark: SparkSession, sf: str) -> DataFrame:
    c = Contract("ridge", ["pm25_lag_24", "temperature", "pm25_lag_1", "hour_sin"])
    return clean.contract_select(features(spark, sf), c, [*SERIES, "datetime"])


def future_horizon(spark: SparkSession, sf: str) -> DataFrame:
    existing, fetched = existing_and_fetched(spark, sf)
    return feeds.future_horizon(fetched, existing, SERIES).select(
        *SERIES, "datetime", "step", "pm10")


def future_grid(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.future_grid(hourly(spark, sf), SERIES)


def order_check(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive a little later than their id says are out of order in time."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("series"), "event_id", "ts")
    mixed = ev.withColumn("arrival", F.col("event_id") + (F.col("event_id") % 3) * 4)
    return out_of_order(mixed, ["arrival", "event_id"], "ts", SERIES, [F.floor(F.col("arrival") / (1 << 16))])


def merge_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf)


def unseen_hours(spark: SparkSession, sf: str) -> DataFrame:
    existing, fetched = existing_and_fetched(spark, sf)
    return tables.unseen(fetched, existing, [*SERIES, "datetime"])


def unseen_by_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched hours that a stored table lacks, by the filters of its keys per date."""
    keys, path = [*SERIES, "datetime"], f"{shared_dir(spark, 'filtered')}/hours"
    dated = lambda df: df.withColumn("date", F.to_date("datetime"))
    existing, fetched = existing_and_fetched(spark, sf)
    stored = dated(existing)
    key_filters.add_filters(stored, path, keys, "date")
    tables.by_date(stored, "date").write.partitionBy("date").parquet(path)
    return key_filters.unseen_filtered(dated(fetched), path, keys, "date").drop("date")


def newest_unseen(spark: SparkSession, sf: str) -> DataFrame:
    existing, fetched = existing_and_fetched(spark, sf)
    return tables.unseen(fetched, existing, [*SERIES, "datetime"], latest_only=True,
                         not_after=datetime(2024, 1, 29, 18))


def band_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from gustline.functions.bands import pm25_category
    bands = band_table(spark).select("category", "emoji", "color", "band")
    h = hourly(spark, sf).withColumn("category", pm25_category("pm25"))
    return h.join(F.broadcast(bands), "category", "left").select(*SERIES, "datetime", "category", "color", "band")


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    existing, fetched = existing_and_fetched(spark, sf)
    new = tables.unseen(fetched, existing, [*SERIES, "datetime"]).withColumns({
        "pm10": F.when(F.hour("datetime") % 4 == 0, F.col("pm10")),
        "co": F.when(F.col("datetime") > F.lit("2024-01-26 00:00:00").cast("timestamp_ntz"), F.col("co"))})
    return feeds.carry_forward(existing, new, ["pm10", "co"], SERIES).select(
        *SERIES, "datetime", "pm25", "pm10", "co")


def append_union(spark: SparkSession, sf: str) -> DataFrame:
    existing, fetched = existing_and_fetched(spark, sf)
    new = tables.unseen(fetched, existing, [*SERIES, "datetime"]).drop("co")
    return existing.unionByName(new, allowMissingColumns=True)


def conform_layout(spark: SparkSession, sf: str) -> DataFrame:
    existing, fetched = existing_and_fetched(spark, sf)
    return clean.conform(fetched.drop("co", "n"), existing)


def latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return latest_row(hourly(spark, sf), SERIES)


def melt_series(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.melt(hourly(spark, sf), [*SERIES, "datetime"], ["pm25", "pm10", "co"])


_UNSEEN = f"SELECT * FROM fetched f WHERE datetime >= TIMESTAMP '{CUT}' OR NOT EXISTS " \
          "(SELECT 1 FROM existing e WHERE e.series = f.series AND e.datetime = f.datetime)"
_DIRTY_COLS = ["series", "datetime", "pm25", "pm10", "co", "n", "no2", "aod"]
_BANDS_SQL = ("CASE WHEN pm25 >= 0 AND pm25 < 12 THEN 1 WHEN pm25 >= 12 AND pm25 < 35 THEN 2 "
              "WHEN pm25 >= 35 AND pm25 < 55 THEN 3 WHEN pm25 >= 55 AND pm25 < 150 THEN 4 "
              "WHEN pm25 >= 150 AND pm25 < 250 THEN 5 ELSE 6 END")

QUERIES = [
    Query("json_hourly_explode", json_hourly_explode, sql("hourly", """,
        p AS (SELECT series, CAST(datetime AS DATE) AS d, list(datetime ORDER BY datetime) AS t,
              list(pm25 ORDER BY datetime) AS a, list(pm10 ORDER BY datetime) AS b, list(co ORDER BY datetime) AS c
              FROM hourly GROUP BY 1, 2)
        SELECT series, unnest(t) AS datetime, unnest(a) AS pm25, unnest(b) AS pm10, unnest(c) AS co FROM p""")),
    Query("payload_quarantine", payload_quarantine, sql("hourly", """,
        d AS (SELECT DISTINCT series, CAST(datetime AS DATE) AS day FROM hourly)
        SELECT series, CASE day(day) % 7 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'empty' WHEN 2 THEN 'empty'
        ELSE 'valid' END AS reason, count(*) AS n FROM d GROUP BY 1, 2""")),
    Query("json_nested_reading", json_nested_reading, """
        SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN floor(value) END AS aqi, value AS pm25,
        CASE WHEN event_id % 3 = 0 THEN value * 2 END AS pm10, CAST(NULL AS DOUBLE) AS no2
        FROM events WHERE event_id % 11 <> 0"""),
    Query("snapshot_pair", snapshot_pair, sql("merged", """
        SELECT series, datetime, CAST(n AS DOUBLE) AS aqi, pm25, temperature, humidity,
        CAST(NULL AS DOUBLE) AS wind_speed, CAST(n AS DOUBLE) AS clouds FROM merged WHERE hour(datetime) <> 9""")),
    Query("date_range_scan", date_range_scan, """
        SELECT event_id, event_type, value FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'"""),
    Query("snapshot_sink", snapshot_sink, sql("hourly", """
        SELECT CAST(datetime AS DATE) AS ingest_date, count(*) AS n_rows, round(sum(pm25), 6) AS sum_pm25,
        true AS fresh FROM hourly GROUP BY 1""")),
    Query("upsert_latest", upsert_latest, sql("existing fetched", """,
        u AS (SELECT *, 1 AS ingest FROM existing UNION ALL
              SELECT series, datetime, pm25 + 1 AS pm25, pm10, co, n, 2 AS ingest FROM fetched)
        SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY series, datetime ORDER BY ingest DESC) = 1""")),
    Query("dedupe_keep_last", dedupe_keep_last, """
        SELECT event_type AS series, date_trunc('hour', ts) AS datetime, ts, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1"""),
    Query("dedupe_rows", dedupe_rows, sql("dirty", "SELECT DISTINCT * EXCLUDE (no2) FROM dirty")),
    Query("tz_normalise", tz_normalise, """
        SELECT event_id, ts AS local, ts - INTERVAL 5 HOUR AS utc FROM events"""),
    Query("null_profile", null_profile, sql("dirty", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"round((count(*) - count({c})) / count(*), 6) AS null_ratio FROM dirty" for c in _DIRTY_COLS))),
    Query("negative_profile", negative_profile, sql("dirty", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} < 0) AS BIGINT) AS n_negative FROM dirty"
        for c in ("pm25", "pm10", "co", "no2")))),
    Query("validate_clean", validate_clean, sql("dirty", """
        SELECT series, datetime, pm25, pm10, co, n FROM dirty
        WHERE pm25 >= 0 AND pm10 >= 0 AND co >= 0""")),
    Query("dropna_subset", dropna_subset, sql("dirty", """
        SELECT series, datetime, pm25, pm10, co FROM dirty WHERE pm25 IS NOT NULL AND pm10 IS NOT NULL""")),
    Query("contract_select", contract_select, sql("features", """
        SELECT series, datetime, pm25_lag_24, temperature, pm25_lag_1, hour_sin FROM features""")),
    Query("future_horizon", future_horizon, sql("existing fetched", """,
        l AS (SELECT series, max(datetime) AS last FROM existing GROUP BY 1),
        r AS (SELECT f.series, f.datetime, f.pm10,
              row_number() OVER (PARTITION BY f.series ORDER BY f.datetime) AS step
              FROM fetched f JOIN l USING (series) WHERE f.datetime > l.last)
        SELECT series, datetime, step, pm10 FROM r WHERE step <= 72""")),
    Query("future_grid", future_grid, sql("hourly", """,
        l AS (SELECT series, max(datetime) AS last FROM hourly GROUP BY 1)
        SELECT series, CAST(s AS INTEGER) AS step, last + to_hours(s) AS datetime
        FROM l, range(1, 169) t(s)""")),
    Query("order_check", order_check, """
        WITH a AS (SELECT event_type AS series, ts, event_id, event_id + (event_id % 3) * 4 AS arrival FROM events),
        b AS (SELECT series, lag(ts) OVER (PARTITION BY series ORDER BY arrival, event_id) >= ts AS late FROM a)
        SELECT series, count(*) AS n_rows, count(*) FILTER (WHERE late) AS n_out_of_order FROM b GROUP BY 1"""),
    Query("merge_feeds", merge_feeds, sql("merged", "SELECT * FROM merged")),
    Query("unseen_hours", unseen_hours, sql("existing fetched", _UNSEEN)),
    Query("unseen_by_filters", unseen_by_filters, sql("existing fetched", _UNSEEN)),
    Query("newest_unseen", newest_unseen, sql("existing fetched", f""",
        u AS ({_UNSEEN})
        SELECT * FROM u WHERE datetime <= TIMESTAMP '2024-01-29 18:00:00'
        QUALIFY row_number() OVER (PARTITION BY series ORDER BY datetime DESC) = 1""")),
    Query("band_lookup", band_lookup, sql("hourly", f"""
        SELECT series, datetime, ['Good', 'Moderate', 'Unhealthy (Sensitive)', 'Unhealthy', 'Very Unhealthy',
        'Hazardous'][b] AS category, ['#2E9E5B', '#C9A227', '#E8743B', '#D7263D', '#7B2CBF', '#6A040F'][b] AS color,
        b AS band FROM (SELECT *, {_BANDS_SQL} AS b FROM hourly)""")),
    Query("carry_forward", carry_forward, sql("existing fetched", f""",
        u AS (SELECT series, datetime, pm25, CASE WHEN hour(datetime) % 4 = 0 THEN pm10 END AS pm10,
              CASE WHEN datetime > TIMESTAMP '2024-01-26 00:00:00' THEN co END AS co FROM ({_UNSEEN})),
        l AS (SELECT series, max_by(pm10, datetime) AS lp, max_by(co, datetime) AS lc FROM existing GROUP BY 1)
        SELECT u.series, datetime, pm25,
        coalesce(last_value(pm10 IGNORE NULLS) OVER w, lp) AS pm10,
        coalesce(last_value(co IGNORE NULLS) OVER w, lc) AS co
        FROM u LEFT JOIN l ON u.series = l.series
        WINDOW w AS (PARTITION BY u.series ORDER BY datetime ROWS UNBOUNDED PRECEDING)""")),
    Query("append_union", append_union, sql("existing fetched", f"""
        SELECT series, datetime, pm25, pm10, co, n FROM existing UNION ALL
        SELECT series, datetime, pm25, pm10, NULL, n FROM ({_UNSEEN})""")),
    Query("conform_layout", conform_layout, sql("fetched", """
        SELECT series, datetime, pm25, pm10, CAST(NULL AS DOUBLE) AS co, CAST(NULL AS BIGINT) AS n FROM fetched""")),
    Query("latest_row", latest_rows, sql("hourly", """
        SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY series ORDER BY datetime DESC) = 1""")),
    Query("melt_series", melt_series, sql("hourly", """
        SELECT series, datetime, series_name, value FROM
        (UNPIVOT (SELECT series, datetime, pm25, pm10, co FROM hourly) ON pm25, pm10, co
         INTO NAME series_name VALUE value)""")),
]

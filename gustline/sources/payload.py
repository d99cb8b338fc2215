"""JSON payloads: parallel hourly arrays and nested single readings.

Payloads are read from files (``spark.read``) or from a text column; a bad payload goes to a
quarantine table with its reason instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of the hourly payloads and the columns they become.
AIR_FIELDS = {
    "pm2_5": "pm25",
    "pm10": "pm10",
    "carbon_monoxide": "co",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "ozone": "o3",
    "aerosol_optical_depth": "aod",
    "dust": "dust",
}
WEATHER_FIELDS = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "precipitation": "precipitation",
    "surface_pressure": "pressure",
    "wind_speed_10m": "wind_speed",
    "wind_direction_10m": "wind_direction",
    "cloud_cover": "cloud_cover",
    "visibility": "visibility",
    "weather_code": "weather_code",
}
# Pollutants a station reading may hold.
STATION_POLLUTANTS = ["pm25", "pm10", "no2", "so2", "co", "o3"]

CORRUPT = "_corrupt_record"


def hourly_schema(fields: Sequence[str], extra: Sequence[T.StructField] = ()) -> T.StructType:
    """Schema of a payload ``{..., hourly: {time: [...], field: [...]}}``."""
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields]
    return T.StructType([*extra, T.StructField("status", T.StringType()),
                         T.StructField("hourly", T.StructType(arrays)),
                         T.StructField(CORRUPT, T.StringType())])


_READING = T.StructType([T.StructField("v", T.DoubleType())])
STATION_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("aqi", T.DoubleType()),
        T.StructField("iaqi", T.StructType([T.StructField(p, _READING) for p in STATION_POLLUTANTS])),
    ])),
])
WEATHER_NOW_SCHEMA = T.StructType([
    T.StructField("main", T.StructType([T.StructField(n, T.DoubleType())
                                        for n in ("temp", "feels_like", "humidity", "pressure")])),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType())])),
    T.StructField("visibility", T.DoubleType()),
    T.StructField("clouds", T.StructType([T.StructField("all", T.DoubleType())])),
])


def read_hourly_payloads(spark: SparkSession, path: str, fields: dict[str, str],
                         series_cols: Sequence[str] = ()) -> DataFrame:
    """Payload files, one JSON object per line; unreadable lines keep their text."""
    extra = [T.StructField(c, T.StringType()) for c in series_cols]
    return (spark.read.schema(hourly_schema(list(fields), extra))
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))


def parse_payload(text: Column, fields: dict[str, str]) -> Column:
    return F.from_json(text, hourly_schema(list(fields)),
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def explode_hourly(df: DataFrame, fields: dict[str, str], series_cols: Sequence[str] = (),
                   hourly: str = "hourly") -> DataFrame:
    """One row per hour out of parallel arrays, with the canonical column names."""
    present = df.select(f"{hourly}.*").columns
    used = {f: c for f, c in fields.items() if f in present}
    # a field the payload lacks is a null array, which would leave no rows at all
    absent = F.array().cast("array<double>")
    zipped = F.arrays_zip(F.col(f"{hourly}.time").alias("time"),
                          *[F.coalesce(F.col(f"{hourly}.{f}"), absent).alias(f) for f in used])
    rows = df.select(*series_cols, F.inline(zipped))
    return rows.select(*series_cols, F.col("time").cast("timestamp_ntz").alias("datetime"),
                       *[F.col(f).alias(c) for f, c in used.items()])


def quarantine_reason(payload: Column | None = None, expect_status: bool = False) -> Column:
    """Null for a good payload, else why it is refused. Hourly payloads have no status; where a source
    sends one, ``expect_status`` refuses all but "ok"."""
    get = (lambda name: payload[name]) if payload is not None else F.col
    bad_status = F.coalesce(get("status"), F.lit("")) != "ok" if expect_status else F.lit(False)
    no_rows = F.coalesce(F.size(get("hourly")["time"]), F.lit(0)) <= 0
    return (F.when(get(CORRUPT).isNotNull(), "corrupt")
            .when(bad_status, "status").when(no_rows, "empty"))


def split_quarantine(df: DataFrame, payload: Column | None = None, expect_status: bool = False
                     ) -> tuple[DataFrame, DataFrame]:
    """(valid payloads, refused payloads with ``reason``)."""
    marked = df.withColumn("reason", quarantine_reason(payload, expect_status))
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def station_reading(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Flat row of a station reading; any key may be missing. Readings not "ok" are left out."""
    parsed = df.select(*keep, F.from_json(text, STATION_SCHEMA).alias("r"))
    return parsed.where(F.col("r.status") == "ok").select(
        *keep, F.col("r.data.aqi").alias("aqi"),
        *[F.col(f"r.data.iaqi.{p}.v").alias(p) for p in STATION_POLLUTANTS])


def weather_reading(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Flat row of a current-weather object."""
    parsed = df.select(*keep, F.from_json(text, WEATHER_NOW_SCHEMA).alias("r"))
    return parsed.select(
        *keep, F.col("r.main.temp").alias("temperature"), F.col("r.main.feels_like").alias("feels_like"),
        F.col("r.main.humidity").alias("humidity"), F.col("r.main.pressure").alias("pressure"),
        F.col("r.wind.speed").alias("wind_speed"), F.col("r.visibility").alias("visibility"),
        F.col("r.clouds.all").alias("clouds"))


def snapshot_pair(station: DataFrame, weather: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row out of the two readings of the same key and ingest hour."""
    return station.join(weather, [*keys], "inner")

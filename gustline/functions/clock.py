"""Wall-clock time expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hour_floor(ts: Column | str) -> Column:
    """Start of the hour, as a wall-clock timestamp."""
    return F.date_trunc("hour", _col(ts)).cast("timestamp_ntz")


def month_floor(ts: Column | str) -> Column:
    return F.date_trunc("month", _col(ts)).cast("timestamp_ntz")


def day_name(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "EEEE")


def normalise_tz(ts: Column | str, zone: str = "UTC") -> Column:
    """A wall-clock time of ``zone``, as the wall-clock time in UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(ts).cast("timestamp_ntz"))


def add_time_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """hour, day_of_week (Monday is 0), month, day and the hour on the unit circle."""
    t = F.col(ts)
    angle = F.lit(2 * math.pi) * F.hour(t) / F.lit(24)
    return df.withColumns({
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    })

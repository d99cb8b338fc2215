"""Banding and label expressions; every one is a plain Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# PM2.5 bands (low, high, label, emoji, colour), half-open [low, high).
PM25_BANDS = [
    (0, 12, "Good", "🟢", "#2E9E5B"),
    (12, 35, "Moderate", "🟡", "#C9A227"),
    (35, 55, "Unhealthy (Sensitive)", "🟠", "#E8743B"),
    (55, 150, "Unhealthy", "🔴", "#D7263D"),
    (150, 250, "Very Unhealthy", "🟣", "#7B2CBF"),
    (250, 100000, "Hazardous", "⛔", "#6A040F"),
]
# US AQI bands, closed integer ranges [low, high].
US_AQI_BANDS = [
    (0, 50, "Good", "#2E9E5B"),
    (51, 100, "Moderate", "#C9A227"),
    (101, 150, "Unhealthy (Sensitive)", "#E8743B"),
    (151, 200, "Unhealthy", "#D7263D"),
    (201, 300, "Very Unhealthy", "#7B2CBF"),
    (301, 10000, "Hazardous", "#6A040F"),
]
# Label and colours of a missing reading.
UNKNOWN = ("Unknown", "⚪", "#9aa0a6")
# Colour and emoji per status.
STATUS_COLORS = {"NORMAL": "#2E9E5B", "WARNING": "#C9A227", "DRIFT": "#D7263D", "UNKNOWN": "#9aa0a6"}
STATUS_EMOJI = {"NORMAL": "🟢", "WARNING": "🟡", "DRIFT": "🔴", "UNKNOWN": "⚪"}
# Name parts that decide the family of a feature, first match wins.
FAMILY_PATTERNS = [
    ("lag", "Lagged PM2.5"),
    ("roll", "Rolling Window Features"),
    ("hour|day|month|sin|cos|week", "Calendar/Cyclical"),
    ("temp|humid|press|wind|cloud|precip|visib|weather", "Weather Features"),
]
FAMILY_DEFAULT = "Pollutants"
# Upper limits of the train/validation R² gap and their verdicts.
GAP_VERDICTS = [(0.03, "EXCELLENT"), (0.05, "VERY GOOD"), (0.10, "ACCEPTABLE")]
GAP_DEFAULT = "OVERFITTING"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _case(pairs: list[tuple[Column, str]], default: str) -> Column:
    out = None
    for test, label in pairs:
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def missing(value: Column | str) -> Column:
    """Null or NaN."""
    value = _col(value).cast("double")
    return value.isNull() | F.isnan(value)


def pm25_category(value: Column | str, part: int = 2, null_label: str = UNKNOWN[0]) -> Column:
    """Band of a PM2.5 value; ``part`` is 2 for the label, 3 for the emoji, 4 for the colour.

    Values no band holds (below zero) fall through to the last band.
    """
    value = _col(value)
    null_value = null_label if part == 2 else UNKNOWN[part - 2]
    return _case([(missing(value), null_value)]
                 + [((value >= b[0]) & (value < b[1]), b[part]) for b in PM25_BANDS],
                 PM25_BANDS[-1][part])


def us_aqi_category(value: Column | str, part: int = 2) -> Column:
    """US AQI band; ``part`` 2 is the label, 3 the colour. Values between two integer ranges
    match no band and fall through to the last one."""
    value = _col(value)
    null_value = UNKNOWN[0] if part == 2 else UNKNOWN[2]
    return _case([(value.isNull(), null_value)]
                 + [((value >= b[0]) & (value <= b[1]), b[part]) for b in US_AQI_BANDS],
                 US_AQI_BANDS[-1][part])


def pm25_band_order(label: Column | str) -> Column:
    """Position of a PM2.5 label from best to worst."""
    return F.array_position(F.array(*[F.lit(b[2]) for b in PM25_BANDS]), _col(label))


def band_table(spark: SparkSession) -> DataFrame:
    """The PM2.5 bands as a six-row dimension table."""
    rows = [(i, float(b[0]), float(b[1]), b[2], b[3], b[4]) for i, b in enumerate(PM25_BANDS, 1)]
    return spark.createDataFrame(
        rows, "band int, lo double, hi double, category string, emoji string, color string")


def normalize_status(text: Column | str, default: str = "NORMAL") -> Column:
    """DRIFT, WARNING or NORMAL out of a decorated status; other text gives ``default``."""
    upper = F.upper(F.coalesce(_col(text), F.lit("")))
    return _case([(upper.contains(s), s) for s in ("DRIFT", "WARNING", "NORMAL")], default)


def status_emoji(status: Column | str) -> Column:
    return _case([(_col(status) == s, e) for s, e in STATUS_EMOJI.items()], STATUS_EMOJI["UNKNOWN"])


def status_color(status: Column | str) -> Column:
    return _case([(_col(status) == s, c) for s, c in STATUS_COLORS.items()], STATUS_COLORS["UNKNOWN"])


def severity(status: Column | str) -> Column:
    """0 for NORMAL, 1 for WARNING, 2 for DRIFT."""
    status = _col(status)
    return F.when(status == "DRIFT", 2).when(status == "WARNING", 1).otherwise(0)


def feature_family(name: Column | str) -> Column:
    lower = F.lower(_col(name))
    return _case([(lower.rlike(p), label) for p, label in FAMILY_PATTERNS], FAMILY_DEFAULT)


def gap_verdict(gap: Column | str) -> Column:
    gap = _col(gap)
    return _case([(gap <= limit, label) for limit, label in GAP_VERDICTS], GAP_DEFAULT)


def register_sql(spark: SparkSession) -> None:
    """The label functions as SQL functions of the session."""
    def bands(rows: list[tuple], upper: str) -> str:
        return " ".join(f"WHEN v >= {b[0]} AND v {upper} {b[1]} THEN '{b[2]}'" for b in rows)

    families = " ".join(f"WHEN lower(v) RLIKE '{p}' THEN '{label}'" for p, label in FAMILY_PATTERNS)
    verdicts = " ".join(f"WHEN v <= {limit} THEN '{label}'" for limit, label in GAP_VERDICTS)
    bodies = {
        "pm25_category": ("DOUBLE", f"CASE WHEN v IS NULL OR isnan(v) THEN 'Unknown' "
                                    f"{bands(PM25_BANDS, '<')} ELSE 'Hazardous' END"),
        "us_aqi_category": ("DOUBLE", f"CASE WHEN v IS NULL THEN 'Unknown' "
                                      f"{bands(US_AQI_BANDS, '<=')} ELSE 'Hazardous' END"),
        "feature_family": ("STRING", f"CASE {families} ELSE '{FAMILY_DEFAULT}' END"),
        "gap_verdict": ("DOUBLE", f"CASE {verdicts} ELSE '{GAP_DEFAULT}' END"),
    }
    for name, (arg, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v {arg}) RETURNS STRING RETURN {body}")

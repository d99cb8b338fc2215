"""Small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"
#: A table is sent whole to every executor only up to this many rows.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts without other letters take the quicker way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def pieces(text: Column, separator: str) -> Column:
    """The non-empty parts between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def text_key(text: Column) -> Column:
    """Tells apart rows that share a ``doc_id``; null and empty texts get the same key."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Mark a stored side for broadcast if its counted rows allow it; else joins shuffle it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of columns that treats two nulls as equal."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

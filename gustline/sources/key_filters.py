"""Bloom filters of the stored keys of a table kept by date, read before the table itself.

A filter is a table of bitmaps of 32,768 bits. The hash of a key names one bitmap among those of its date and ``PROBES`` bits
of it, so a key is looked up by one equi-join that spreads also a single large date over all bitmaps. A date gets as many bitmaps (a power of
two) as its keys so far need; when it has grown beyond them, later keys get a larger layer of their own and the
older layer stays as it is. A key is new for certain when no layer has all its bits.

Filters are written before the rows they stand for: a job that dies between leaves bits without rows, which cost a
reading but no result. Every writer of the table must add to them; ``filtered`` builds them from
the stored rows where there are none. Null keys are keys like others, and rows without a time form a date of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.operators.blocks import null_safe_join
from gustline.sources.tables import path_exists, unseen

BITS = 32_768           # of the bitmaps of Spark's bitmap functions
BITS_PER_KEY = 16
PROBES = 6
LAYER = ["_layer", "_bitmap"]


def filter_path(path: str) -> str:
    """Beside the table, so that readers of the table do not meet it."""
    return f"{path.rstrip('/')}-keys"


def _hash(keys: Sequence[str]) -> Column:
    # a hash skips nulls: which keys are null is hashed along
    return F.xxhash64(*keys, *[F.col(k).isNull() for k in keys])


def _bitmap(of: Column, layer: Column) -> Column:
    return F.pmod(of, layer).cast("int")


def _bit(of: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(probe)), F.lit(BITS))


def _layer_for(keys: Column) -> Column:
    """The power of two of bitmaps that so many keys need."""
    needed = F.greatest(F.ceil(keys * BITS_PER_KEY / BITS), F.lit(1))
    return F.pow(F.lit(2.0), F.ceil(F.round(F.log2(needed.cast("double")), 9))).cast("bigint")


def make_filters(rows: DataFrame, keys: Sequence[str], part: str, before: DataFrame | None = None) -> DataFrame:
    """part, layer, bitmap, keys, bits: the filters of rows that are about to be stored beside those of ``before``.

    ``rows`` is read twice: counted by date, then hashed.
    """
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_keys"))
    if before is not None:
        held = before.groupBy(part).agg(F.sum("n_keys").alias("_held"))
        counts = null_safe_join(counts, held, [part], "left").withColumn("_keys", F.col("_keys") + F.coalesce("_held", F.lit(0)))
    layers = counts.select(part, _layer_for(F.col("_keys")).alias("_layer"))       # one row per date
    hashed = null_safe_join(rows.select(part, _hash(keys).alias("_hash")), layers, [part])
    bits = hashed.select(part, "_layer", _bitmap(F.col("_hash"), F.col("_layer")).alias("_bitmap"), F.posexplode(
        F.array(*[_bit(F.col("_hash"), i) for i in range(PROBES)])).alias("_probe", "_bit"))
    return bits.groupBy(part, *LAYER).agg(F.count_if(F.col("_probe") == 0).alias("n_keys"),
                                          F.bitmap_construct_agg("_bit").alias("bits"))


def _has(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("bit_get", byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def probed(rows: DataFrame, filters: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """``rows`` with ``_maybe``: false for keys that are not stored, true for all that are and for few others."""
    merged = filters.groupBy(part, *LAYER).agg(F.bitmap_or_agg("bits").alias("bits"))
    layers = filters.select(part, "_layer").distinct()      # few per date: each is at least twice the one before
    asked = null_safe_join(rows.select(part, _hash(keys).alias("_hash")).distinct(), layers, [part])
    asked = asked.withColumn("_bitmap", _bitmap(F.col("_hash"), F.col("_layer")))
    found = null_safe_join(asked, merged, [part, *LAYER])
    every = F.lit(True)
    for i in range(PROBES):
        every = every & _has(F.col("bits"), _bit(F.col("_hash"), i))
    hits = found.where(every).select(part, "_hash", F.lit(True).alias("_maybe")).distinct()
    marked = null_safe_join(rows.withColumn("_hash", _hash(keys)), hits, [part, "_hash"], "left")
    return marked.withColumn("_maybe", F.coalesce("_maybe", F.lit(False))).drop("_hash")


def unseen_filtered(rows: DataFrame, path: str, keys: Sequence[str], part: str) -> DataFrame:
    """Rows whose key the table at ``path`` (parquet, partitioned by ``part``) does not hold.

    The filters clear most rows. Only those that may be stored are compared, and only dates that hold
    such rows are read. ``rows`` (with ``part``) is read twice; store or persist it.
    """
    spark = rows.sparkSession
    marked = probed(rows, spark.read.parquet(filter_path(path)), keys, part)
    maybe = marked.where("_maybe").drop("_maybe")
    dates = [r[part] for r in maybe.select(part).distinct().collect()]      # one per date
    stored = stored_dates(spark, path, rows, part, dates)
    return marked.where("not _maybe").drop("_maybe").unionByName(unseen(maybe, stored, keys))


def stored_dates(spark: SparkSession, path: str, rows: DataFrame, part: str, dates: Sequence) -> DataFrame:
    """These dates of the table; the condition prunes folders, so no file of another date is opened."""
    wanted = F.col(part).isin([d for d in dates if d is not None])
    if None in dates:
        wanted = wanted | F.col(part).isNull()
    return spark.read.schema(rows.schema).parquet(path).where(wanted)


def filtered(spark: SparkSession, path: str, keys: Sequence[str], part: str) -> None:
    """See that the stored rows have filters."""
    if not path_exists(spark, f"{filter_path(path)}/_SUCCESS"):
        make_filters(spark.read.parquet(path), keys, part).write.mode("overwrite").parquet(filter_path(path))


def add_filters(rows: DataFrame, path: str, keys: Sequence[str], part: str) -> None:
    """Add the keys of rows to the filters; to be called before the rows themselves are appended."""
    spark, at = rows.sparkSession, filter_path(path)
    before = spark.read.parquet(at) if path_exists(spark, f"{at}/_SUCCESS") else None
    make_filters(rows, keys, part, before).write.mode("append").parquet(at)

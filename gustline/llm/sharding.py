"""Shards as runs of a Hilbert curve over document metadata.

Language, source and size are quantised at approximate quantiles into a grid; the cells are taken in the
order of a Hilbert curve, and the curve is cut into runs of nearly equal bytes. Neighbours on
the curve are close in every dimension, so a file holds few languages, sources and size ranges and the
minima and maxima of its columns let a reader skip it.

No text moves: one shuffle carries ids, sizes and checksums. Cells are cut by a hash into buckets
whose number follows the bytes of the cell, so a cell with a third of all rows is spread like the rest.
The running sums go over the buckets, whose number the parameters bound (cells + 8 x ``grain`` x shards at most).

Defined results: a null text has no bytes (size 1, checksum 0); null metadata sorts before all
values; a null ``doc_id`` is placed like any other; repeated rows are placed one by one; an empty table gives
an empty result; a text longer than a shard makes its shard that much larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 4
GRAIN = 512


def _code(value: Column) -> Column:
    """The first six bytes of a string as a number: keeps the order of strings."""
    head = F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))


def _borders(values: list[Column], bits: int) -> list[Column]:
    parts = [k / 2 ** bits for k in range(1, 2 ** bits)]
    return [F.percentile_approx(v, F.array(*map(F.lit, parts)), F.lit(10_000)) for v in values]


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point with coordinates of ``bits`` bits each.

    The coordinates become the transposed index in two folds over (bit, axis) steps: first the
    rotations are undone from the highest bit down, then the Gray code is applied.
    """
    n = len(axes)
    point = F.array(*[a.cast("int") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        here = F.get(x, step["i"])
        first = F.get(x, F.lit(0))
        is_set = here.bitwiseAND(step["q"]) != 0
        flip = first.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(x, lambda v, k: F.when(
            is_set, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
            F.when((k == 0) & (step["i"] != 0), v.bitwiseXOR(flip)).when((k == step["i"]) & (k != 0), v.bitwiseXOR(flip))
            .otherwise(v)))

    undone = F.aggregate(steps, point, undo)
    gray = F.aggregate(
        undone, F.array().cast("array<int>"),
        lambda done, v: F.concat(done, F.array(v.bitwiseXOR(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0))))))

    def twisted(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        twist = F.lit(0)
        for b in range(bits - 1, 0, -1):
            twist = twist.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(0))
        return F.transform(x, lambda v: v.bitwiseXOR(twist))

    # one more fold over a single element binds the Gray code to a name instead of repeating it
    final = F.aggregate(F.array(gray), F.array().cast("array<int>"), lambda _, x: twisted(x))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i"))
                       for b in range(bits - 1, -1, -1) for i in range(n)])
    bound = F.aggregate(
        F.array(final), F.lit(0),
        lambda _, x: F.aggregate(places, F.lit(0), lambda acc, p: acc * 2 + F.when(
            F.get(x, p["i"]).bitwiseAND(F.call_function("shiftleft", F.lit(1), p["b"])) != 0, 1).otherwise(0)))
    return bound


OUTPUTS = ("size", "text_crc32", "curve", "shard", "slot")


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = BITS, grain: int = GRAIN,
                   keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row with size, text_crc32, curve, shard and slot (gapless from 0); kept columns of these names are replaced.

    Shards hold nearly equal bytes: a bucket goes where its middle lies, and a bucket holds about
    1 / ``grain`` of a shard, or a single document.
    """
    keep = ["doc_id"] if keep is None else [c for c in keep if c not in OUTPUTS]
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    dims = [_code(F.col("lang")), _code(F.col("source")),
            (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("double")]
    at = docs.agg(*[b.alias(f"b{k}") for k, b in enumerate(_borders(dims, bits))]).first()
    axes = []
    for k, value in enumerate(dims):
        borders = at[k] or [0.0]
        axes.append(F.size(F.filter(F.array(*map(F.lit, borders)), lambda b, v=value: b < v)))
    slim = docs.select(
        *[F.col(c).alias(f"s_{c}") for c in keep],
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"), hilbert_index(axes, bits).alias("curve"),
        F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))).alias("mix"))
    cells = slim.groupBy("curve").agg(F.sum("size").alias("cell_bytes"))
    total = Window.partitionBy()
    cells = cells.select("curve", F.greatest(F.lit(1), F.ceil(
        F.col("cell_bytes") * (grain * shards) / F.sum("cell_bytes").over(total))).cast("long").alias("cuts"))
    # at most 2 ** (bits x dimensions) cells
    placed = (slim.join(F.broadcast(cells), "curve")
              .withColumn("bucket", F.pmod("mix", "cuts")))
    buckets = placed.groupBy("curve", "bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    run = Window.orderBy("curve", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        "curve", "bucket", "rows",
        F.least(F.lit(shards - 1), F.floor(
            (F.coalesce(F.sum("bytes").over(run), F.lit(0)) + F.col("bytes") / 2) * shards
            / F.sum("bytes").over(total))).cast("int").alias("shard"))
    inside = Window.partitionBy("shard").orderBy("curve", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("rows").over(inside), F.lit(0))).drop("rows")
    order = Window.partitionBy("curve", "bucket").orderBy("mix", *[f"s_{c}" for c in keep])
    return (placed.withColumn("nth", F.row_number().over(order) - 1)
            .join(F.broadcast(buckets), ["curve", "bucket"])
            .select(*[F.col(f"s_{c}").alias(c) for c in keep], "size", "text_crc32", "curve", "shard",
                    (F.col("before") + F.col("nth")).cast("long").alias("slot")))


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard and place of every document, under the law of equal bytes."""
    return hilbert_shards(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")

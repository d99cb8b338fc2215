"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.session import materialise


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger end to the smaller."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex that each vertex of ``edges`` (u, v) reaches.

    Large and small stars in turn: the neighbours of a vertex that are larger than it, then those that are smaller, are
    hung below the smallest of them. Every round is stored, so a lost executor costs its tasks only.
    Edges with a null end are left out.
    """
    now = materialise(_down(edges), "edges")
    state = None
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = _down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(large, "large-star")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = materialise(_down(small), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("v"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("v"), F.col("v").alias("component")).distinct())

"""Data drift between a reference and a recent sample: Kolmogorov–Smirnov and PSI.

All statistics come from one table of distinct values per feature with their counts in both
samples, cumulated along the value axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.functions.kolmogorov import asymptotic_p, exact_p
from gustline.operators.blocks import null_safe_join, salted_lookup
from gustline.operators.order_stats import cumulate, quantiles, value_counts
from gustline.session import materialise

KS_THRESHOLD = 0.05
PSI_WARN = 0.10
PSI_DRIFT = 0.20
PSI_BUCKETS = 10
PSI_FLOOR = 1e-6


def both_samples(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Cumulated value counts per feature out of rows with ``role`` reference or recent."""
    keys = [*by, "feature"]
    long = df.select(*by, "role", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [*by, "role"], list(cols), "feature", "value")
    counts = value_counts(long, keys, "value", {
        "ref": F.when(F.col("role") == "reference", 1).otherwise(0),
        "rec": F.when(F.col("role") == "recent", 1).otherwise(0)})
    return cumulate(counts, keys, "value", ["ref", "rec"], bounded_keys=not by)


def ks_statistic(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D = max |F_ref - F_rec| per feature; features with fewer than 2 values are left out."""
    gap = F.abs(F.col("cum_ref") / F.col("total_ref") - F.col("cum_rec") / F.col("total_rec"))
    return (samples.where((F.col("total_ref") >= 2) & (F.col("total_rec") >= 2))
            .groupBy(*by, "feature").agg(
                F.max("total_ref").alias("n_ref"), F.max("total_rec").alias("n_rec"),
                F.max(gap).alias("d")))


def with_asymptotic_p(ks: DataFrame) -> DataFrame:
    return ks.withColumn("p_asymptotic", asymptotic_p(F.col("d"), F.col("n_ref"), F.col("n_rec")))


def with_p_value(ks: DataFrame, method: str = "asymptotic") -> DataFrame:
    """p-value by one method for all rows: "asymptotic", a column expression, or "exact", whose cost
    is the product of the sample sizes. ``ks_method`` names it."""
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"unknown method {method!r}")
    value = (exact_p("d", "n_ref", "n_rec") if method == "exact"
             else asymptotic_p(F.col("d"), F.col("n_ref"), F.col("n_rec")))
    return ks.withColumns({"ks_pvalue": value, "ks_method": F.lit(method)})


def _bin(value: str, edges: str, buckets: int) -> Column:
    """Bin number from 1; the last bin is closed, values outside the edges have none."""
    passed = " + ".join(f"CAST(coalesce({value} >= get({edges}, {i}), false) AS INT)" for i in range(buckets + 1))
    return F.expr(f"CASE WHEN {value} >= get({edges}, 0) AND {value} <= get({edges}, size({edges}) - 1) "
                  f"THEN least({passed}, size({edges}) - 1) END")


def psi(samples: DataFrame, by: Sequence[str] = (), buckets: int = PSI_BUCKETS) -> DataFrame:
    """Population stability index on bins of reference quantiles, rounded to 4 places.

    Too few values or fewer than three distinct edges give 0; a recent sample that lies wholly
    outside the edges gives null.
    """
    keys = [*by, "feature"]
    edges = (quantiles(samples, keys, "value", "ref", [i / buckets for i in range(buckets + 1)])
             .select(*keys, F.array_sort(F.array_distinct("q")).alias("edges")))
    with_edges = (salted_lookup(samples, edges, keys, how="left") if by
                  else null_safe_join(samples, F.broadcast(edges), keys, "left"))
    at = _bin("value", "edges", buckets)

    counted = with_edges.withColumn("_bin", at).groupBy(*keys).agg(
        F.max("total_ref").alias("n_ref"), F.max("total_rec").alias("n_rec"),
        F.coalesce(F.max(F.size("edges")), F.lit(0)).alias("n_edges"),
        _per_bin("ref", buckets).alias("ref_bins"), _per_bin("rec", buckets).alias("rec_bins"))
    return counted.select(*keys, "n_ref", "n_rec", "n_edges", _psi_value().alias("psi"))


def _per_bin(weight: str, buckets: int) -> Column:
    return F.expr("array(" + ", ".join(f"coalesce(sum(CASE WHEN _bin = {i} THEN {weight} END), 0)"
                                       for i in range(1, buckets + 1)) + ")")


def _psi_value() -> Column:
    """The index out of ``ref_bins``, ``rec_bins``, ``n_edges`` and the sizes of both samples."""
    def share(bins: str) -> Column:
        used = F.slice(F.col(bins), 1, F.greatest(F.col("n_edges") - 1, F.lit(1)))
        total = F.aggregate(used, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(total > 0, F.transform(used, lambda x: F.greatest(x / total, F.lit(PSI_FLOOR))))

    terms = F.zip_with(share("ref_bins"), share("rec_bins"), lambda e, a: (a - e) * F.ln(a / e))
    value = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    too_few = (F.col("n_ref") < 2) | (F.col("n_rec") < 2) | (F.col("n_edges") < 3)
    return F.when(too_few, F.lit(0.0)).otherwise(F.round(value, 4))


def classify(p: Column | str, psi_value: Column | str) -> Column:
    """DRIFT needs a significant KS test and a large PSI; either signal alone is a WARNING."""
    p = F.col(p) if isinstance(p, str) else p
    psi_value = F.col(psi_value) if isinstance(psi_value, str) else psi_value
    significant = p.isNotNull() & ~F.isnan(p) & (p < KS_THRESHOLD)
    known = psi_value.isNotNull() & ~F.isnan(psi_value)
    return (F.when(significant & known & (psi_value >= PSI_DRIFT), "DRIFT")
            .when(significant | (known & (psi_value >= PSI_WARN)), "WARNING").otherwise("NORMAL"))


def drift_report(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                 buckets: int = PSI_BUCKETS, p_column: str = "ks_pvalue") -> DataFrame:
    """KS, PSI and status per feature of rows with a ``role``.

    ``p_column`` "ks_pvalue" is the exact value, "p_asymptotic" the limit distribution, without any
    Python worker.
    """
    samples = materialise(both_samples(df, cols, by), "samples")
    ks = ks_statistic(samples, by)
    ks = with_p_value(ks, "exact") if p_column == "ks_pvalue" else with_asymptotic_p(ks)
    joined = null_safe_join(ks, psi(samples, by, buckets).select(*by, "feature", "psi"), [*by, "feature"])
    return joined.withColumns({"status": classify(p_column, "psi"), p_column: F.round(p_column, 6)})


# -- a stored reference -------------------------------------------------------------------------
CELL_VALUES = 20_000


def reference_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct values per feature with their counts. Such tables of two samples add up to that of both."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([*by], list(cols), "feature", "value")
    return value_counts(long, [*by, "feature"], "value", {"ref": F.lit(1).cast("bigint")})


def merged_counts(*parts: DataFrame) -> DataFrame:
    """The counts of several reference samples as those of one."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*[c for c in whole.columns if c != "ref"]).agg(F.sum("ref").alias("ref"))


def save_reference(counts: DataFrame, path: str, by: Sequence[str] = (), buckets: int = PSI_BUCKETS) -> None:
    """Store what every later comparison needs of a reference sample, below ``path``.

    ``steps``: the distinct values in cells of about ``CELL_VALUES``; ``facts``, one row per feature: borders of its cells, rows before
    each cell, edges and counts of the PSI bins.
    """
    keys = [*by, "feature"]
    counts = materialise(counts, "reference-counts")
    parts = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = max(1, -(-(parts.agg(F.max("_n")).first()[0] or 1) // CELL_VALUES))
    cuts = F.array(*[F.lit(k / most) for k in range(1, most)]) if most > 1 else None
    borders = counts.groupBy(*keys).agg((F.percentile_approx("value", cuts, F.lit(20 * most)) if cuts is not None
                                         else F.array().cast("array<double>")).alias("borders"))
    steps = (salted_lookup(counts, borders, keys)
             .withColumn("cell", F.size(F.filter("borders", lambda b: b < F.col("value")))).drop("borders"))
    (steps.repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", "value").write.parquet(f"{path}/steps"))
    steps = counts.sparkSession.read.parquet(f"{path}/steps")

    per_cell = steps.groupBy(*keys, "cell").agg(F.sum("ref").alias("n"))
    sizes = per_cell.groupBy(*keys).agg(      # one entry per cell
        F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("n"), F.sum("n").alias("n_ref"))
    before = F.transform(F.sequence(F.lit(0), F.size("borders")), lambda c: F.aggregate(
        F.filter(F.map_keys("n"), lambda k: k < c), F.lit(0).cast("bigint"), lambda a, k: a + F.col("n")[k]))
    cells = null_safe_join(borders, sizes, keys).select(*keys, "borders", before.alias("before"), "n_ref")

    cumulated = cumulate(counts, keys, "value", ["ref"], bounded_keys=not by)
    edges = (quantiles(materialise(cumulated, "reference-cumulated"), keys, "value", "ref", [i / buckets for i in range(buckets + 1)])
             .select(*keys, F.array_sort(F.array_distinct("q")).alias("edges")))
    binned = salted_lookup(counts, edges, keys).withColumn("_bin", _bin("value", "edges", buckets))
    bins = binned.groupBy(*keys).agg(F.first("edges").alias("edges"), _per_bin("ref", buckets).alias("ref_bins"))
    null_safe_join(cells, bins, keys).write.parquet(f"{path}/facts")


def drift_against(spark: SparkSession, path: str, recent: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                  buckets: int = PSI_BUCKETS) -> DataFrame:
    """KS, PSI and status of a recent sample against a stored reference: the rows of ``drift_report``, with sizes and ``d``.

    Only the cells of the reference in which recent values lie are read beside them: between two recent values the recent distribution stands
    still, so the largest difference is at a value of such a cell or at the cell's beginning.
    """
    keys = [*by, "feature"]
    facts = spark.read.parquet(f"{path}/facts")
    counts = materialise(reference_counts(recent, cols, by).withColumnRenamed("ref", "rec"), "recent-counts")
    known = salted_lookup(counts, facts.select(*keys, "borders", "edges"), keys)
    known = materialise(known.withColumns({"cell": F.size(F.filter("borders", lambda b: b < F.col("value"))),
                                           "_bin": _bin("value", "edges", buckets)}).drop("borders", "edges"), "recent-cells")
    touched = known.groupBy(*keys, "cell").agg(F.sum("rec").alias("_in"))
    order = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)    # one row per touched cell
    whole = Window.partitionBy(*keys)
    touched = touched.withColumns({"rec_before": F.coalesce(F.sum("_in").over(order), F.lit(0)), "n_rec": F.sum("_in").over(whole)}).drop("_in")
    touched = null_safe_join(touched, facts.select(*keys, "before", "n_ref"), keys)
    touched = materialise(touched.withColumn("ref_before", F.get("before", F.col("cell"))).drop("before"), "touched-cells")

    steps = spark.read.parquet(f"{path}/steps")
    steps = null_safe_join(steps, touched.select(*keys, "cell"), [*keys, "cell"])
    both = (steps.select(*keys, "cell", "value", "ref", F.lit(0).cast("bigint").alias("rec"))
            .unionByName(known.select(*keys, "cell", "value", F.lit(0).cast("bigint").alias("ref"), "rec"))
            .groupBy(*keys, "cell", "value").agg(F.sum("ref").alias("ref"), F.sum("rec").alias("rec")))
    inside = Window.partitionBy(*keys, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"cum_ref": F.sum("ref").over(inside), "cum_rec": F.sum("rec").over(inside)})
    both = salted_lookup(both, touched, [*keys, "cell"])
    gap = F.greatest(
        F.abs((F.col("ref_before") + F.col("cum_ref")) / F.col("n_ref") - (F.col("rec_before") + F.col("cum_rec")) / F.col("n_rec")),
        F.abs(F.col("ref_before") / F.col("n_ref") - F.col("rec_before") / F.col("n_rec")))
    ks = (both.where((F.col("n_ref") >= 2) & (F.col("n_rec") >= 2)).groupBy(*keys)
          .agg(F.max("n_ref").alias("n_ref"), F.max("n_rec").alias("n_rec"), F.max(gap).alias("d")))
    bins = known.groupBy(*keys).agg(_per_bin("rec", buckets).alias("rec_bins"))
    bins = null_safe_join(bins, facts.select(*keys, F.size("edges").alias("n_edges"), "ref_bins"), keys)
    out = with_asymptotic_p(null_safe_join(ks, bins, keys)).withColumn("psi", _psi_value())
    return out.select(*keys, "n_ref", "n_rec", "d", F.round("p_asymptotic", 6).alias("p_asymptotic"), "psi",
                      classify("p_asymptotic", "psi").alias("status"))

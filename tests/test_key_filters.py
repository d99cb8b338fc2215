"""Filters of stored keys: nothing stored is missed, other dates are not read, dates grow in layers."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gustline.sources import key_filters, tables

KEYS = ["s", "datetime"]
SCHEMA = "s string, datetime timestamp_ntz, v int, date date"


def rows_of(spark, days, names, hours=24, v=1):
    out = [(s, datetime(2024, 1, d, h), v, date(2024, 1, d)) for d in days for s in names for h in range(hours)]
    return spark.createDataFrame(out, SCHEMA)


def store(df, path):
    key_filters.add_filters(df, path, KEYS, "date")
    df.write.mode("append").partitionBy("date").parquet(path)


def keys_of(df):
    return sorted(((r.s, r.datetime) for r in df.select(*KEYS).collect()), key=repr)


def files_read(df):
    return {f.split("date=")[1].split("/")[0] for f in df.inputFiles()}


@pytest.fixture()
def path(tmp_path):
    return f"{tmp_path}/table"


def test_equals_the_anti_join_and_reads_dates_with_candidates_only(spark, path):
    store(rows_of(spark, range(1, 8), ["a", "b", None]), path)
    new = rows_of(spark, [3], ["a", "c"], v=2).union(rows_of(spark, [5, 6, 20], ["d", "e"], v=2)).union(
        spark.createDataFrame([(None, datetime(2024, 1, 4, 1), 2, date(2024, 1, 4)), ("a", None, 2, None)], SCHEMA))
    got = key_filters.unseen_filtered(new, path, KEYS, "date")
    assert keys_of(got) == keys_of(tables.unseen(new, spark.read.schema(new.schema).parquet(path), KEYS))
    marked = key_filters.probed(new, spark.read.parquet(key_filters.filter_path(path)), KEYS, "date")
    dates = [r.date for r in marked.where("_maybe").select("date").distinct().collect()]
    assert set(dates) == {date(2024, 1, 3), date(2024, 1, 4)}
    scan = key_filters.stored_dates(spark, path, new, "date", dates)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [date" in plan
    read = {r.date for r in scan.select("date").distinct().collect()}
    assert read == set(dates) and files_read(scan) >= {"2024-01-03", "2024-01-04"}
    metrics = {k: m.value() for k, m in _scan_metrics(scan)}
    assert metrics["numPartitions"] == 2


def _scan_metrics(df):
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    plan.executeCollect()
    while plan.children().size():
        plan = plan.children().apply(0)
    found = plan.metrics()
    names = found.keys().iterator()
    while names.hasNext():
        name = names.next()
        yield name, found.apply(name)


def test_no_false_negative_and_few_false_positives(spark):
    start = datetime(2024, 1, 1)
    ids = spark.range(60_000).select(F.format_string("k%d", "id").alias("s"), F.lit(start).cast("timestamp_ntz").alias("datetime"),
                                     F.lit(1).alias("v"), F.lit(start.date()).alias("date"))
    odd, even = ids.where("substr(s, 2) % 2 = 1"), ids.where("substr(s, 2) % 2 = 0")
    filters = key_filters.make_filters(even, KEYS, "date").cache()
    assert filters.agg(F.sum("n_keys")).first()[0] == 30_000 and {r._layer for r in filters.collect()} == {16}
    assert key_filters.probed(even, filters, KEYS, "date").where("not _maybe").count() == 0
    assert key_filters.probed(odd, filters, KEYS, "date").where("_maybe").count() < 300
    filters.unpersist()


def test_a_growing_date_gets_layers(spark, path):
    def part(a, b):
        return spark.range(a, b).select(F.col("id").cast("string").alias("s"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("datetime"),
                                        F.lit(1).alias("v"), F.lit(date(2024, 1, 1)).alias("date"))

    for a in range(0, 12_000, 1_500):
        store(part(a, a + 1_500), path)
    filters = spark.read.parquet(key_filters.filter_path(path))
    layers = {r._layer: r.n for r in filters.groupBy("_layer").agg(F.sum("n_keys").alias("n")).collect()}
    assert sum(layers.values()) == 12_000 and set(layers) == {1, 2, 4, 8}
    assert all(n * key_filters.BITS_PER_KEY <= layer * key_filters.BITS for layer, n in layers.items())
    asked = part(0, 24_000)
    assert key_filters.unseen_filtered(asked, path, KEYS, "date").count() == 12_000
    assert key_filters.probed(asked, filters, KEYS, "date").where("_maybe").count() < 12_300


def test_tables_without_filters_and_empty_ones(spark, path):
    rows_of(spark, [1, 2], ["a"]).write.partitionBy("date").parquet(path)
    key_filters.filtered(spark, path, KEYS, "date")
    assert key_filters.unseen_filtered(rows_of(spark, [1, 3], ["a"]), path, KEYS, "date").count() == 24
    nothing = rows_of(spark, [1], ["a"]).where("false")
    assert key_filters.unseen_filtered(nothing, path, KEYS, "date").count() == 0
    store(nothing, path)
    assert key_filters.unseen_filtered(rows_of(spark, [1], ["a"]), path, KEYS, "date").count() == 0


def test_repeated_rows_stay_as_with_the_anti_join(spark, path):
    store(rows_of(spark, [1], ["a"]), path)
    twice = rows_of(spark, [1, 2], ["a"])
    twice = twice.union(twice)
    assert key_filters.unseen_filtered(twice, path, KEYS, "date").count() == 48

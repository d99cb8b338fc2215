import json
from datetime import date, datetime

import pandas as pd
import pytest
from series_frames import hours, to_spark
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.functions import bands
from gustline.operators import clean, feeds, summary
from gustline.session import shared_dir
from gustline.sources import payload, tables
from gustline.spec import Contract


@pytest.fixture
def folder(spark):
    return shared_dir(spark, "test")


def labels(spark, values, expr):
    return [r[0] for r in spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").select(expr).collect()]


# -- labels ---------------------------------------------------------------------------------
def test_pm25_bands(spark):
    got = labels(spark, [0, 5, 12, 20, 35, 45, 55, 100, 150, 200, 250, 400, -1, None, float("nan")], bands.pm25_category("v"))
    assert got == ["Good", "Good", "Moderate", "Moderate", "Unhealthy (Sensitive)", "Unhealthy (Sensitive)", "Unhealthy",
                   "Unhealthy", "Very Unhealthy", "Very Unhealthy", "Hazardous", "Hazardous", "Hazardous", "Unknown", "Unknown"]
    assert labels(spark, [50], bands.pm25_category("v", part=3)) == ["🟠"]
    assert labels(spark, [None], bands.pm25_category("v", null_label="Hazardous")) == ["Hazardous"]


def test_us_aqi_gap_between_ranges(spark):
    assert labels(spark, [50, 50.5, 51, None], bands.us_aqi_category("v")) == ["Good", "Hazardous", "Moderate", "Unknown"]


def test_verdicts_families_statuses(spark):
    assert labels(spark, [.03, .05, .10, .11], bands.gap_verdict("v")) == ["EXCELLENT", "VERY GOOD", "ACCEPTABLE", "OVERFITTING"]
    names = ["pm25_lag_1", "pm25_roll_std_6", "hour_sin", "day_of_week", "wind_speed", "weather_code", "no2"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(bands.feature_family("n")).collect()
    assert [r[0] for r in got] == ["Lagged PM2.5", "Rolling Window Features", "Calendar/Cyclical", "Calendar/Cyclical",
                                   "Weather Features", "Weather Features", "Pollutants"]
    s = spark.createDataFrame([("🔴 drift",), ("🟡 Warning",), ("odd",), (None,)], "s string")
    assert [tuple(r) for r in s.select(bands.normalize_status("s"), bands.normalize_status("s", "UNKNOWN")).collect()] == [
        ("DRIFT", "DRIFT"), ("WARNING", "WARNING"), ("NORMAL", "UNKNOWN"), ("NORMAL", "UNKNOWN")]


def test_sql_functions_agree(spark):
    bands.register_sql(spark)
    df = spark.range(-2, 320).select((F.col("id") + 0.5).alias("v")).unionByName(spark.range(0, 310).select(F.col("id").cast("double").alias("v")))
    wrong = df.where((F.expr("pm25_category(v)") != bands.pm25_category("v")) | (F.expr("us_aqi_category(v)") != bands.us_aqi_category("v"))
                     | (F.expr("gap_verdict(v / 1000)") != bands.gap_verdict(F.col("v") / 1000)))
    assert wrong.count() == 0


# -- cleaning -------------------------------------------------------------------------------
def test_validate(spark):
    n = 100
    pdf = pd.DataFrame({"datetime": hours(n), "pm25": 1.0, "pm10": 2.0, "co": 3.0, "no2": float("nan"), "aod": 1.0, "dust": 1.0})
    pdf.loc[:80, "aod"] = None      # 81 of 100: more than 80 %
    pdf.loc[:79, "dust"] = None     # exactly 80 %: stays
    pdf.loc[[85, 90], "co"] = [-1.0, None]
    df = to_spark(spark, pdf)
    out = clean.validate(df)
    assert out.columns == ["datetime", "pm25", "pm10", "co", "dust"] and out.count() == 18
    assert clean.sparse_columns(df) == ["no2", "aod"]
    prof = {r["column_name"]: r for r in clean.profile(df).collect()}
    assert prof["co"]["n_negative"] == 1 and prof["no2"]["n_null"] == n and prof["dust"]["null_ratio"] == pytest.approx(.8)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3.0)], "a int, pm25 double, s string, datetime double")
    assert clean.numeric_columns(df) == ["a", "pm25", "datetime"]
    assert clean.features_to_check(df) == ["a"]
    assert clean.features_to_check(df, Contract("m", ["zz", "a"])) == ["a"]
    assert clean.candidate_features(df)[1] == ["a"]
    assert clean.contract_select(df, Contract("m", ["s", "a"])).columns == ["s", "a"]
    assert clean.conform(df.select("a"), df).columns == df.columns
    with pytest.raises(ValueError, match="zz"):
        clean.contract_select(df, Contract("m", ["zz"]))
    assert clean.dedupe_rows(df.union(df).toDF("A", "B", "C", "D")).columns == ["a", "b", "c", "d"]


def test_carry_forward_and_horizon(spark):
    old = to_spark(spark, pd.DataFrame({"s": "a", "datetime": hours(5), "x": [1.0, 2, 3, 4, None], "y": [1.0] * 5}))
    new = to_spark(spark, pd.DataFrame({"s": "a", "datetime": hours(4, "2024-01-02"), "x": [None, 7.0, None, None], "y": [None] * 4}))
    new = new.withColumn("y", F.col("y").cast("double"))
    got = feeds.carry_forward(old, new, ["x", "y"], ["s"]).orderBy("datetime").collect()
    assert [r["x"] for r in got] == [None, 7, 7, 7] and [r["y"] for r in got] == [1.0] * 4
    ahead = feeds.future_horizon(new, old, ["s"], 2).orderBy("step").collect()
    assert [r["step"] for r in ahead] == [1, 2] and ahead[0]["datetime"] == datetime(2024, 1, 2)


def test_absent_weekday_and_ties(spark):
    df = to_spark(spark, pd.DataFrame({"datetime": hours(48), "pm25": [5.0] * 24 + [20.0] * 24}))      # Monday, Tuesday
    got = summary.weekday_mean(df).orderBy("position").collect()
    assert [r["mean_value"] for r in got] == [5.0, 20.0] + [None] * 5
    assert summary.dominant_category(df).first()["dominant"] == "Good"
    assert summary.histogram(df.withColumn("pm25", F.lit(3.0)), "pm25").first()["n"] == 48
    assert summary.diurnal_boxplot(df).where("hour = 3").first()["median"] == 12.5


# -- sources and sinks ----------------------------------------------------------------------
def test_payload_files(spark, tmp_path):
    good = {"series": "a", "status": "ok", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "pm2_5": [1.5, None], "pm10": [3.0, 4.0]}}
    lines = [json.dumps(good), json.dumps({**good, "status": "error"}), json.dumps({**good, "hourly": {}}), '{"broken": ']
    (tmp_path / "p.json").write_text("\n".join(lines))
    df = payload.read_hourly_payloads(spark, str(tmp_path / "p.json"), payload.AIR_FIELDS, ["series"]).cache()
    valid, refused = payload.split_quarantine(df, expect_status=True)
    assert sorted(r["reason"] for r in refused.collect()) == ["corrupt", "empty", "status"]
    rows = payload.explode_hourly(valid, payload.AIR_FIELDS, ["series"]).orderBy("datetime").collect()
    assert [(r["pm25"], r["pm10"], r["dust"]) for r in rows] == [(1.5, 3.0, None), (None, 4.0, None)]
    assert rows[1]["datetime"] == datetime(2024, 1, 1, 1)


def test_nested_readings(spark):
    station = [('{"status":"ok","data":{"aqi":57,"iaqi":{"pm25":{"v":12.5}}}}',), ('{"status":"error"}',), ('{"status":"ok","data":{}}',)]
    got = payload.station_reading(spark.createDataFrame(station, "t string"), "t").collect()
    assert [(r["aqi"], r["pm25"], r["o3"]) for r in got] == [(57.0, 12.5, None), (None, None, None)]
    now = '{"main":{"temp":20.5,"feels_like":19,"humidity":40,"pressure":1010},"wind":{"speed":3},"clouds":{"all":75}}'
    r = payload.weather_reading(spark.createDataFrame([(now,)], "t string"), "t").first()
    assert (r["temperature"], r["clouds"], r["visibility"]) == (20.5, 75.0, None)


def test_versions_can_replace_what_they_read(spark, folder):
    tables.write_version(spark.range(3), folder)
    tables.write_version(tables.read_version(spark, folder).where("id > 0"), folder)
    assert tables.read_version(spark, folder).count() == 2 and tables.read_version(spark, folder, 1).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, folder + "-none")


def test_upsert_touches_only_new_dates(spark, folder):
    old = to_spark(spark, pd.DataFrame({"s": "a", "datetime": hours(72), "v": 1.0})).withColumn("b", F.lit(0))
    new = to_spark(spark, pd.DataFrame({"s": "a", "datetime": hours(30, "2024-01-03"), "v": 2.0})).withColumn("b", F.lit(1))
    tables.upsert_partitions(old, folder, ["s", "datetime"], ["b"])
    def older():
        return {f for f in tables.read_upserted(spark, folder).inputFiles() if "date=2024-01-01" in f or "date=2024-01-02" in f}

    before = older()
    tables.upsert_partitions(new, folder, ["s", "datetime"], ["b"])
    got = tables.read_upserted(spark, folder)
    assert got.count() == 78 and got.where("v = 2").count() == 30
    assert before and before == older()
    assert tables.restore(old.unionByName(old), ["s", "datetime"], ["b"]).count() == 72


def test_unseen(spark):
    a = to_spark(spark, pd.DataFrame({"s": "a", "datetime": hours(10), "v": 1.0}))
    b = to_spark(spark, pd.DataFrame({"s": "a", "datetime": hours(20), "v": 2.0}))
    assert tables.unseen(b, a, ["s", "datetime"]).count() == 10
    newest = tables.unseen(b, a, ["s", "datetime"], latest_only=True, not_after=datetime(2024, 1, 1, 15)).collect()
    assert [r["datetime"] for r in newest] == [datetime(2024, 1, 1, 15)]


def test_optional_source_and_reports(spark, folder):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("s", T.StringType())])
    assert tables.read_or_empty(spark, folder, schema).count() == 0
    df = spark.createDataFrame([(1, "x"), (2, None)], schema)
    tables.write_csv(df, folder + "/c")
    assert sorted(map(tuple, tables.read_csv(spark, folder + "/c", schema).collect())) == [(1, "x"), (2, None)]
    tables.write_report(df.coalesce(1), folder + "/j")
    assert spark.read.schema(schema).json(folder + "/j").count() == 2
    tables.append_history(df, folder + "/h")
    tables.append_history(df, folder + "/h")
    assert spark.read.parquet(folder + "/h").count() == 4
    fresh = {r["artefact"]: r["n_files"] for r in tables.freshness(spark, {"h": folder + "/h", "none": folder + "/n"}).collect()}
    assert fresh["h"] > 0 and fresh["none"] == 0
    tables.save_selection({"ridge": ["a", "b"], "none": []}, spark, folder + "/s")
    assert tables.load_selection(spark, folder + "/s", "ridge") == ["a", "b"]
    with pytest.raises(KeyError):
        tables.load_selection(spark, folder + "/s", "x")


def test_report_over_several_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"feature": "a", "psi": 0.1}, {"feature": "b", "psi": None}], indent=2))
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("psi", T.DoubleType())])
    assert sorted(map(tuple, tables.read_report(spark, str(tmp_path / "r.json"), schema).collect())) == [("a", .1), ("b", None)]


def test_reports_of_many_rows_beside_documents(spark, tmp_path):
    path = f"{tmp_path}/re port"
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("psi", T.DoubleType())])
    rows = [(f"f{i}", None if i % 3 == 0 else i / 8) for i in range(40)]
    tables.write_report(spark.createDataFrame(rows, schema).coalesce(2), path)
    assert sorted(map(tuple, tables.read_report(spark, path, schema).collect())) == sorted(rows)
    (tmp_path / "re port" / "one.json").write_text(json.dumps({"feature": "x", "psi": 9.0}, indent=1))
    (tmp_path / "re port" / "two.json").write_text(json.dumps([{"feature": "y", "psi": 8.0}, {"feature": "z", "psi": None}]))
    want = sorted([*rows, ("x", 9.0), ("y", 8.0), ("z", None)])
    assert sorted(map(tuple, tables.read_report(spark, path, schema).collect())) == want
    assert sorted((r.feature, r.psi) for r in tables.read_report(spark, path).collect()) == want


@pytest.mark.parametrize("names,suffix", [(("feature", "mean_abs_shap"), "csv"), (("Feature_Name", "SHAP"), "json"), (("feature", "importance"), "parquet")])
def test_importance_sources(spark, tmp_path, names, suffix):
    path = str(tmp_path / f"imp.{suffix}")
    pdf = pd.DataFrame({names[0]: ["a", "b"], names[1]: [0.1, 0.7]})
    {"csv": lambda: pdf.to_csv(path, index=False), "json": lambda: pdf.to_json(path, orient="records"), "parquet": lambda: pdf.to_parquet(path)}[suffix]()
    got = tables.read_importance(spark, [str(tmp_path / "none.csv"), path]).collect()
    assert [tuple(r) for r in got] == [("b", .7), ("a", .1)]
    assert tables.canonical_importance(spark.range(1)) is None


def test_missing_artefacts(spark):
    need = spark.createDataFrame([("ridge", "model"), ("ridge", "scaler")], "m string, file string")
    have = spark.createDataFrame([("ridge", "model")], "m string, file string")
    assert [r["file"] for r in tables.missing_artefacts(have, need, ["m", "file"]).collect()] == ["scaler"]


def test_date_filter_reaches_the_scan(spark, folder):
    to_spark(spark, pd.DataFrame({"datetime": hours(48), "pm25": 1.0, "co": 2.0})).write.parquet(folder)
    df = tables.date_range_scan(spark, folder, datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 9)).select("pm25")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 5 and "PushedFilters: [IsNotNull(datetime), GreaterThanOrEqual" in plan
    assert "ReadSchema: struct<datetime:timestamp_ntz,pm25:double>" in plan


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_corrupt_optional_source(spark, tmp_path, fmt):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    (tmp_path / f"bad.{fmt}").write_text("{\"a\": 1")
    assert tables.read_or_empty(spark, str(tmp_path / f"bad.{fmt}"), schema, fmt).count() == 0
    good = str(tmp_path / "good")
    spark.createDataFrame([(1,), (2,)], schema).write.format(fmt).save(good)
    assert tables.read_or_empty(spark, good, schema, fmt).count() == 2
    part = next(p for p in (tmp_path / "good").iterdir() if p.name.startswith("part-"))
    part.with_name("part-bad." + fmt).write_text("{\"a\": tru")
    assert tables.read_or_empty(spark, good, schema, fmt).count() == 0


def test_upsert_keeps_rows_without_time_or_series(spark, folder):
    schema = "s string, datetime timestamp_ntz, v int, t int"
    hour = datetime(2024, 1, 1, 5)
    first = spark.createDataFrame([("a", None, 1, 1), (None, hour, 2, 1), ("a", hour, 3, 1)], schema)
    tables.upsert_partitions(first, folder, ["s", "datetime"], ["t"])
    second = spark.createDataFrame([("b", None, 4, 2), (None, hour, 5, 2)], schema)
    tables.upsert_partitions(second, folder, ["s", "datetime"], ["t"])
    got = {(r.s, r.datetime): r.v for r in tables.read_upserted(spark, folder).collect()}
    assert got == {("a", None): 1, ("b", None): 4, (None, hour): 5, ("a", hour): 3}


def test_a_reader_never_sees_half_an_upsert(spark, folder, monkeypatch):
    """A job that dies while it writes, and one that dies after its folders are written, leave the old state of all dates."""
    keys = ["s", "datetime"]
    old = to_spark(spark, pd.DataFrame({"s": "a", "datetime": hours(72), "v": 1.0})).withColumn("b", F.lit(0))
    tables.upsert_partitions(old, folder, keys, ["b"])
    new = old.withColumns({"v": F.lit(2.0), "b": F.lit(1)})

    def state():
        return sorted(map(tuple, tables.read_upserted(spark, folder).groupBy("v").count().collect()))

    breaks = new.withColumn("v", F.when(F.dayofmonth("datetime") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        tables.upsert_partitions(breaks, folder, keys, ["b"])
    assert state() == [(1.0, 72)]
    with monkeypatch.context() as m:
        m.setattr(tables, "switch_pointer", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            tables.upsert_partitions(new, folder, keys, ["b"])
    assert state() == [(1.0, 72)]
    reader = tables.read_upserted(spark, folder)        # planned before the switch
    tables.upsert_partitions(new, folder, keys, ["b"])
    assert state() == [(2.0, 72)] and reader.where("v = 1").count() == 72
    tables.upsert_partitions(new.where(F.dayofmonth("datetime") == 2).withColumns({"v": F.lit(3.0), "b": F.lit(2)}), folder, keys, ["b"])
    assert state() == [(2.0, 48), (3.0, 24)]
    import os
    left = {d for d, _, files in os.walk(f"{folder}/data") if any(f.endswith(".parquet") for f in files)}
    assert len(left) == 4 and len(os.listdir(f"{folder}/states")) == 2      # three dates now, and the one before
    day = tables.read_upserted(spark, folder, date(2024, 1, 2), date(2024, 1, 2))
    assert day.count() == 24 and all("_date=2024-01-02" in f for f in day.inputFiles())
    assert tables.read_upserted(spark, folder, date(2030, 1, 1)).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_upserted(spark, folder + "-none")


def test_null_series_meet(spark):
    rows = spark.createDataFrame([(None, datetime(2024, 1, 1), 1.0), ("a", datetime(2024, 1, 1), 2.0)],
                                 "s string, datetime timestamp_ntz, v double")
    assert tables.unseen(rows, rows, ["s", "datetime"]).count() == 0
    from gustline.operators.feeds import merge_feeds
    assert merge_feeds(rows, rows.withColumnRenamed("v", "w"), ["s"]).count() == 2


def test_hourly_payload_needs_no_status(spark):
    from pyspark.sql import functions as F

    from gustline.sources import payload
    text = '{"latitude": 24.8, "hourly": {"time": ["2024-01-01T00:00"], "pm2_5": [3.5], "pm10": [7.0]}}'
    df = spark.createDataFrame([(text,)], "t string").select(payload.parse_payload(F.col("t"), payload.AIR_FIELDS).alias("p"))
    valid, refused = payload.split_quarantine(df, F.col("p"))
    assert (valid.count(), refused.count()) == (1, 0)
    assert payload.split_quarantine(df, F.col("p"), expect_status=True)[1].first()["reason"] == "status"


def test_hours_are_stored_once_however_late(spark, folder):
    """Old hours again, hours of a series far behind, rows without series or time, and a batch that is repeated."""
    from gustline.streaming.hourly import stream_once
    schema = "s string, datetime timestamp_ntz, v int"

    def hour(day, h=0):
        return datetime(2024, 1, day, h)

    deliveries = [[("hot", hour(9), 1), ("hot", hour(9), 1), ("hot", hour(20), 1), (None, hour(9), 1), ("hot", None, 1)],
                  [("hot", hour(9), 2), ("slow", hour(1), 2), ("slow", hour(9), 2), (None, hour(9), 2), ("hot", None, 2)],
                  [("hot", hour(20), 3), ("slow", hour(1), 3), ("slow", hour(2), 3), ("hot", hour(20, 1), 3)]]
    want = {("hot", hour(9)): 1, ("hot", hour(20)): 1, (None, hour(9)): 1, ("hot", None): 1, ("slow", hour(1)): 2,
            ("slow", hour(9)): 2, ("slow", hour(2)): 3, ("hot", hour(20, 1)): 3}

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        stream_once(stream, f"{folder}/out", f"{folder}/{checkpoint}", ["s", "datetime"]).awaitTermination()
        return [((r.s, r.datetime), r.v) for r in spark.read.parquet(f"{folder}/out").collect()]

    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = run("checkpoint")
    assert len(got) == len(want) and dict(got) == want
    got = run("another")    # all of it again, as after a lost checkpoint
    assert len(got) == len(want) and dict(got) == want

import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gustline.functions.kolmogorov import exact_two_sample
from gustline.operators import alerts, drift, order_stats
from gustline.operators.order_stats import group_quantiles
from gustline.spec import FeatureSpec


def d_statistic(a, b):
    x = np.sort(np.concatenate([a, b]))
    return np.max(np.abs(np.searchsorted(np.sort(a), x, "right") / len(a)
                         - np.searchsorted(np.sort(b), x, "right") / len(b)))


def psi_by_hand(expected, actual, buckets=10):
    if len(expected) < 2 or len(actual) < 2:
        return 0.0
    edges = np.unique(np.percentile(expected, np.arange(buckets + 1) * 100 / buckets))
    if len(edges) < 3:
        return 0.0
    share = [np.maximum(c / c.sum(), 1e-6) for c in (np.histogram(expected, edges)[0], np.histogram(actual, edges)[0])]
    return float(np.sum((share[1] - share[0]) * np.log(share[1] / share[0])))


CASES = {
    "same": lambda g: (g.normal(50, 10, 2000),) * 2,
    "shifted": lambda g: (g.normal(50, 10, 2000), g.normal(85, 10, 2000)),
    "tied": lambda g: (g.integers(0, 8, 500).astype(float), g.integers(2, 9, 72).astype(float)),
    "outlier": lambda g: (np.append(g.normal(0, 1, 1500), 1e9), g.normal(0.3, 1, 72)),
    "tiny": lambda g: (1e9 + g.normal(0, 1e-3, 800), 1e9 + g.normal(1e-3, 1e-3, 300)),
    "constant": lambda g: (np.full(50, 3.0), np.full(20, 3.0)),
    "one third equal": lambda g: (np.append(g.normal(0, 1, 600), np.zeros(300)), g.normal(0, 1, 300)),
}


@pytest.fixture(scope="module")
def results(spark):
    data, frames = {}, []
    for name, make in CASES.items():
        ref, rec = make(np.random.default_rng(0))
        data[name] = (ref, rec)
        frames += [pd.DataFrame({"case": name, "role": r, "x": v}) for r, v in (("reference", ref), ("recent", rec))]
    df = spark.createDataFrame(pd.concat(frames, ignore_index=True))
    samples = drift.both_samples(df, ["x"], ["case"])
    rows = drift.ks_statistic(samples, ["case"]).join(
        drift.psi(samples, ["case"]).select("case", "psi", "n_edges"), "case").collect()
    return data, {r["case"]: r for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_ks_and_psi_equal_numpy(results, name):
    data, rows = results
    ref, rec = data[name]
    assert rows[name]["d"] == pytest.approx(d_statistic(ref, rec), abs=1e-12)
    assert rows[name]["psi"] == pytest.approx(psi_by_hand(ref, rec), abs=1e-4)


def test_psi_properties(results):
    _, rows = results
    assert rows["same"]["psi"] < 0.01 and rows["shifted"]["psi"] > 0.2 and rows["constant"]["psi"] == 0.0


def test_no_rows_give_no_report(spark):
    empty = spark.createDataFrame([], "role string, x double")
    assert drift.drift_report(empty, ["x"], p_column="p_asymptotic").count() == 0


def test_recent_sample_outside_the_edges(spark):
    pdf = pd.DataFrame({"role": ["reference"] * 40 + ["recent"] * 5, "x": [*map(float, range(40)), *[99.0] * 5]})
    got = drift.psi(drift.both_samples(spark.createDataFrame(pdf), ["x"])).first()
    assert got["psi"] is None


@pytest.mark.parametrize("m,n", [(3, 4), (5, 5), (4, 7)])
def test_exact_p_by_enumeration(m, n):
    values = []
    for pick in combinations(range(m + n), m):
        first = np.isin(np.arange(m + n), pick)
        values.append(np.max(np.abs(np.cumsum(first) / m - np.cumsum(~first) / n)))
    for d in sorted(set(np.round(values, 12))):
        want = np.mean(np.asarray(values) >= d - 1e-9)
        assert exact_two_sample(d, m, n) == pytest.approx(want, abs=1e-12)


def test_p_values_agree_for_large_samples():
    # the limit distribution at d = 0.05 for 2000 and 3000 values
    z2 = 0.05 ** 2 * 2000 * 3000 / 5000
    limit = 2 * sum((-1) ** (k - 1) * np.exp(-2.0 * k * k * z2) for k in range(1, 101))
    assert exact_two_sample(0.05, 2000, 3000) == pytest.approx(limit, abs=5e-3)
    assert exact_two_sample(0.0, 10, 10) == 1.0


def test_drift_classes(spark):
    rows = [(.01, .2), (.01, .05), (.5, .1), (.5, .05), (None, .3), (float("nan"), float("nan")), (.01, float("nan"))]
    got = spark.createDataFrame(rows, "p double, psi double").select(drift.classify("p", "psi").alias("s")).collect()
    assert [r["s"] for r in got] == ["DRIFT", "WARNING", "WARNING", "NORMAL", "WARNING", "NORMAL", "WARNING"]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.lognormal(0, 3, 997), "b": rng.integers(0, 5, 300).astype(float), "c": np.array([4.2])}
    pdf = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in groups.items()])
    probs = [0, .1, .25, .5, .75, .9, 1]
    for bounded in (True, False):
        got = {r["g"]: r["q"] for r in group_quantiles(spark.createDataFrame(pdf), ["g"], "x", probs, bounded).collect()}
        for k, v in groups.items():
            np.testing.assert_allclose(got[k], np.percentile(v, np.array(probs) * 100), rtol=1e-12)


def test_percentile_golden(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "x double").withColumn("g", F.lit(1))
    assert group_quantiles(df, ["g"], "x", [.1, .25], True).first()["q"] == pytest.approx([1.3, 1.75])


def test_model_degradation(spark):
    pairs = spark.createDataFrame([(5.2485, 4.4932), (1.2, 1.0), (1.4, 1.0)], "c double, b double")
    share = alerts.degradation(F.col("c"), F.col("b"))
    got = pairs.select(F.round(share * 100, 2).alias("pct"), alerts.degradation_status(share).alias("s")).collect()
    assert (got[0]["pct"], got[0]["s"]) == (16.81, "NORMAL")
    assert got[1]["pct"] == 20.0 and got[2]["s"] in ("DRIFT", "WARNING")


@pytest.mark.parametrize("drifted,total,want", [(7, 10, "DRIFT"), (2, 10, "WARNING"), (1, 10, "NORMAL"), (0, 0, "NORMAL")])
def test_data_severity(spark, drifted, total, want):
    rows = [("🔴 DRIFT" if i < drifted else "🟡 WARNING",) for i in range(total)]
    got = alerts.assess_data_drift(spark.createDataFrame(rows, "status string")).first()
    assert (got["data_severity"], got["drifted"], got["total"]) == (want, drifted, total)


def test_rollup_and_message(spark):
    data = spark.createDataFrame([("a", "🔴 DRIFT")] * 7 + [("a", "🟡 WARNING")] * 3, "series string, status string")
    model = spark.createDataFrame([("a", "🟢 NORMAL", 16.81, 5.2485, 4.4932), ("b", "🔴 DRIFT", 50.0, 3.0, 2.0)],
                                  "series string, status string, rmse_degradation_pct double, rmse double, baseline_rmse double")
    got = {r["series"]: r for r in alerts.alert_message(alerts.alert_rollup(data, model, ["series"])).collect()}
    assert got["a"]["overall_status"] == "DRIFT" and not got["a"]["retrain_recommended"] and got["a"]["fraction"] == 0.7
    assert got["b"]["retrain_recommended"] and got["b"]["total"] == 0
    assert "Monitoring run: DRIFT" in got["a"]["message"] and "7 of 10 features moved" in got["a"]["message"]


def test_consecutive_runs(spark):
    runs = [("a", i, s) for i, s in enumerate(["DRIFT", "NORMAL", "DRIFT", "DRIFT"])] + [("b", i, "🔴 DRIFT") for i in range(4)] \
        + [("c", 0, "DRIFT"), ("c", 1, "NORMAL")]
    got = {r["s"]: r for r in alerts.consecutive_drift(
        spark.createDataFrame(runs, "s string, timestamp int, status string"), ["s"]).collect()}
    assert [got[s]["consecutive"] for s in "abc"] == [2, 4, 0]
    assert [got[s]["retrain_sustained"] for s in "abc"] == [False, True, False]
    assert [got[s]["retrain_single_run"] for s in "abc"] == [True, True, False]
    assert got["b"]["progress"] == 1.0


def test_p_value_method_is_asked_for(spark):
    ks = spark.createDataFrame([("x", 8, 9, 0.5), ("y", 20_000, 30_000, 0.01)], "feature string, n_ref long, n_rec long, d double")
    got = drift.with_p_value(ks).collect()
    assert {r.ks_method for r in got} == {"asymptotic"} and all(0 < r.ks_pvalue <= 1 for r in got)
    exact = drift.with_p_value(ks.where("feature = 'x'"), "exact").first()
    assert exact.ks_method == "exact" and exact.ks_pvalue == pytest.approx(exact_two_sample(0.5, 8, 9))
    with pytest.raises(ValueError):
        drift.with_p_value(ks, "auto")


def test_cells_are_balanced_on_log_spread_values(spark):
    rng = np.random.default_rng(3)
    values = 10.0 ** rng.uniform(-6, 6, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"f": "x", "v": values}))
    counts = order_stats.value_counts(df, ["f"], "v", {"w": F.lit(1)})
    cells = order_stats.in_cells(counts, ["f"], "v", True).groupBy("_cell").count().toPandas()["count"]
    assert len(cells) > 100 and cells.max() < 4 * cells.mean()
    got = order_stats.group_quantiles(df, ["f"], "v", [0.1, 0.5, 0.93], True).first()["q"]
    assert np.allclose(got, np.quantile(values, [0.1, 0.5, 0.93]))


# -- stored reference, exact p-values, online features ----------------------------------------------
@pytest.mark.parametrize("cell_values", [20_000, 30])
def test_stored_reference_equals_both_samples(spark, tmp_path, monkeypatch, cell_values):
    """Over one cell and over many, several series, a null one, values outside the reference, ties, nulls and NaN."""
    monkeypatch.setattr(drift, "CELL_VALUES", cell_values)
    rng = np.random.default_rng(12)
    parts = []
    for s, n, m, shift in (("a", 900, 80, 0.0), ("b", 200, 40, 1.5), (None, 60, 30, 0.2), ("far", 100, 20, 50.0), ("one", 50, 1, 0.0)):
        for role, size, move in (("reference", n, 0.0), ("recent", m, shift)):
            parts.append(pd.DataFrame({"s": s, "role": role, "x": np.round(rng.normal(move, 1, size), 1), "y": rng.normal(move, 1, size)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype({"s": object}).where(pdf.notna(), None), "s string, role string, x double, y double")
    for by in ([], ["s"]):
        ref = df.where("role = 'reference'")
        halves = [drift.reference_counts(ref.where(c), ["x", "y"], by) for c in ("x > 0", "x is null or x <= 0")]
        path = str(tmp_path / f"ref-{len(by)}")
        drift.save_reference(drift.merged_counts(*halves), path, by)
        got = drift.drift_against(spark, path, df.where("role = 'recent'"), ["x", "y"], by)
        want = drift.drift_report(df, ["x", "y"], by, p_column="p_asymptotic")
        rows = [{(r["s"] if by else "", r["feature"]): (r["n_ref"], r["n_rec"], round(r["d"], 9), r["p_asymptotic"], r["psi"], r["status"])
                 for r in d.collect()} for d in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) == (8 if by else 2)


def test_untouched_cells_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drift, "CELL_VALUES", 10)
    path = str(tmp_path / "ref")
    drift.save_reference(drift.reference_counts(spark.range(1000).select(F.col("id").cast("double").alias("x")), ["x"]), path)
    recent = spark.createDataFrame([(5.0,), (6.0,), (700.0,)], "x double")
    row = drift.drift_against(spark, path, recent, ["x"]).first()
    assert row["d"] == pytest.approx(max(0.7 - 2 / 3, 2 / 3 - 7 / 1000, 0.3), abs=1e-9)
    assert spark.read.parquet(f"{path}/steps").select("cell").distinct().count() > 50


def test_exact_p_value_counts_all_merges():
    for m, n in ((1, 1), (2, 3), (4, 4), (5, 7)):
        reached = []
        for places in combinations(range(m + n), m):
            i = j = d = 0
            for k in range(m + n):
                i, j = (i + 1, j) if k in places else (i, j + 1)
                d = max(d, abs(i * n - j * m))
            reached.append(d)
        for h in range(m * n + 1):
            assert exact_two_sample(h / (m * n), m, n) == pytest.approx(np.mean([d >= h for d in reached]), abs=1e-12)
    start = time.perf_counter()
    assert 0 < exact_two_sample(0.2, 100_000, 72) < 0.01 and time.perf_counter() - start < 1


def test_online_features_of_a_hot_series_in_many_batches(spark, tmp_path):
    from gustline.operators.windows import add_window_features
    from gustline.streaming import hourly as streams
    from gustline.streaming.online import online_features
    spec = FeatureSpec(lags=(1, 5), means=(3, 6), stds=(4,))
    rng = np.random.default_rng(5)
    at = pd.date_range("2024-01-01", periods=400, freq="h")
    pdf = pd.DataFrame({"series": ["hot"] * 380 + ["cold"] * 20, "datetime": list(at[:380]) + list(at[:20]), "pm25": rng.normal(size=400)})
    pdf.loc[rng.random(400) < 0.05, "pm25"] = np.nan
    df = spark.createDataFrame(pdf, "series string, datetime timestamp_ntz, pm25 double").withColumn("pm25", F.expr("nullif(pm25, 'NaN')"))
    for k in range(0, 400, 16):     # deliveries of 16 hours, each a batch of its own
        first, last = at[k], at[min(k + 15, 399)]
        df.where(F.col("datetime").between(F.lit(first), F.lit(last))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.where("series = 'hot' and datetime < '2024-01-01 03:00:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))     # late
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.stream_append(online_features(stream, spec, ["series"]), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert len(query.recentProgress) > 20
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("late").count() == 3 and out.where("late").select(spec.columns[0]).distinct().collect()[0][0] is None
    got = out.where("not late").toPandas().sort_values(["series", "datetime"])[spec.columns].to_numpy(float)
    want = add_window_features(df, spec, ["series"]).toPandas().sort_values(["series", "datetime"])[spec.columns].to_numpy(float)
    np.testing.assert_allclose(got, want, atol=1e-9)

import numpy as np
import pandas as pd
import pytest
from series_frames import hours, to_spark
from pyspark.sql import functions as F

from gustline.operators.blocks import fill_forward, with_row_index
from gustline.operators.windows import add_timed_features, add_window_features, build_features, trailing_mean
from gustline.spec import FORECAST_SPEC, FeatureSpec, split_columns

KEYS = ["series", "datetime"]


def frame(df, cols):
    return df.toPandas().sort_values(KEYS).reset_index(drop=True)[cols].astype(float)


def by_pandas(pdf, spec):
    out = []
    for _, g in pdf.sort_values(KEYS).groupby("series"):
        y = g["pm25"]
        cols = {}
        for n in spec.lags:
            lag = y.shift(n)
            if spec.mode == "expanding_past":
                lag = lag.where(np.arange(len(y)) >= n, y.shift(1))
            cols[f"pm25_lag_{n}"] = lag
        for kind, sizes in (("mean", spec.means), ("std", spec.stds)):
            for n in sizes:
                base = y if spec.mode == "inclusive" else y.shift(1)
                roll = base.rolling(n, min_periods=n if spec.mode == "strict" else 1)
                value = getattr(roll, kind)()
                if kind == "std" and spec.mode != "strict":
                    value = value.where(base.rolling(n, min_periods=1).count() > 1, 0.0)
                    if spec.mode == "expanding_past":
                        value.iloc[0] = np.nan
                cols[f"pm25_roll_{kind}_{n}"] = value
        out.append(pd.DataFrame(cols))
    return pd.concat(out, ignore_index=True)[spec.columns].astype(float)


@pytest.mark.parametrize("block_rows", [None, 24, 100, 8192])
@pytest.mark.parametrize("spec", [
    FeatureSpec(stds=(6,)), FeatureSpec(means=(3, 24), stds=(3, 24), mode="inclusive"), FORECAST_SPEC],
    ids=lambda s: s.mode)
def test_modes_equal_pandas_for_any_block_size(spark, ar_series, spec, block_rows):
    got = frame(add_window_features(to_spark(spark, ar_series), spec, ["series"], block_rows=block_rows), spec.columns)
    pd.testing.assert_frame_equal(got, by_pandas(ar_series, spec), check_names=False)


def test_single_series_without_key_columns(spark, ar_series):
    one = ar_series[ar_series["series"] == "a"]
    got = add_window_features(to_spark(spark, one).drop("series"), FeatureSpec(), [], block_rows=50)
    got = got.toPandas().sort_values("datetime")["pm25_lag_24"].to_numpy(float)
    np.testing.assert_allclose(got, one["pm25"].shift(24).to_numpy())


def test_strict_features_do_not_leak(spark, ar_series):
    """Changing the current and all later targets leaves the features of a row as they are."""
    spec = FeatureSpec()
    cut = pd.Timestamp("2024-01-10")
    changed = ar_series.copy()
    changed.loc[changed["datetime"] >= cut, "pm25"] += 1000
    a, b = (add_window_features(to_spark(spark, p), spec, ["series"]).where(F.col("datetime") <= cut)
            for p in (ar_series, changed))
    pd.testing.assert_frame_equal(frame(a, spec.columns), frame(b, spec.columns))


def test_null_target_empties_the_full_window(spark):
    pdf = pd.DataFrame({"series": "a", "datetime": hours(10), "pm25": [1.0, 2, None, 4, 5, 6, 7, 8, 9, 10]})
    spec = FeatureSpec(lags=(), means=(3,))
    got = frame(add_window_features(to_spark(spark, pdf), spec, ["series"]), spec.columns)["pm25_roll_mean_3"]
    assert got.isna().tolist() == [True] * 6 + [False] * 4
    assert got[6] == 5.0


def test_row_index_and_totals(spark, ar_series):
    got = with_row_index(to_spark(spark, ar_series), ["series"], totals={"_s": F.col("pm25")}).toPandas()
    for name, g in got.sort_values("datetime").groupby("series"):
        assert g["_idx"].tolist() == list(range(1, len(g) + 1))
        assert set(g["_n"]) == {len(g)}
        assert g["_s"].iloc[0] == pytest.approx(ar_series.loc[ar_series["series"] == name, "pm25"].sum())


def test_timed_lag_is_null_for_a_missing_hour(spark):
    pdf = pd.DataFrame({"series": "a", "datetime": hours(40), "pm25": np.arange(40.0)}).drop(index=[5, 6])
    spec = FeatureSpec(lags=(1, 24), means=(3,))
    got = add_timed_features(to_spark(spark, pdf), spec, ["series"]).toPandas().set_index("datetime").sort_index()
    at = lambda h, c: got.loc[pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h), c]
    assert pd.isna(at(7, "pm25_lag_1")) and at(8, "pm25_lag_1") == 7
    assert at(30, "pm25_lag_24") != at(30, "pm25_lag_24") and at(31, "pm25_lag_24") == 7
    assert pd.isna(at(9, "pm25_roll_mean_3")) and at(10, "pm25_roll_mean_3") == 8


def test_fill_forward(spark, ar_series):
    pdf = ar_series.copy()
    pdf.loc[pdf.index % 5 != 0, "pm25"] = None
    pdf.loc[(pdf["series"] == "a") & (pdf["datetime"] > "2024-01-20"), "pm25"] = None
    got = frame(fill_forward(to_spark(spark, pdf), ["pm25"], ["series"], bucket=F.to_date("datetime")), ["pm25"])
    want = pdf.sort_values(KEYS).groupby("series")["pm25"].ffill().reset_index(drop=True)
    np.testing.assert_allclose(got["pm25"], want)


def test_trailing_mean_and_warm_up(spark, ar_series):
    got = frame(trailing_mean(to_spark(spark, ar_series), "pm25", 6, "t", ["series"], block_rows=30), ["t"])["t"]
    want = ar_series.sort_values(KEYS).groupby("series")["pm25"].rolling(6).mean().to_numpy()
    np.testing.assert_allclose(got, want)
    assert build_features(to_spark(spark, ar_series), FeatureSpec(), ["series"]).count() == len(ar_series) - 48


def test_spec_from_columns():
    cols = ["datetime", "pm25", "pm10", "pm25_lag_24", "pm25_lag_3", "pm25_roll_mean_6", "pm25_roll_std_12", "hour"]
    spec = FeatureSpec.from_columns(cols)
    assert (spec.lags, spec.means, spec.stds) == ((3, 24), (6,), (12,))
    base, derived = split_columns(cols)
    assert base == ["datetime", "pm25", "pm10"] and "hour" in derived
    with pytest.raises(ValueError):
        FeatureSpec(mode="other")


def test_rows_without_a_series_name_form_their_own_series(spark, ar_series):
    pdf = ar_series.copy()
    pdf["series"] = pdf["series"].where(pdf["series"] == "a", None)
    got = add_window_features(to_spark(spark, pdf), FeatureSpec(means=()), ["series"], block_rows=50).toPandas()
    assert len(got) == len(pdf) and got["pm25_lag_1"].isna().sum() == 2

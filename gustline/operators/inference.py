"""Batch scoring, recursive forecasts and backtests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions.bands import pm25_category
from gustline.functions.clock import add_time_features
from gustline.operators.blocks import IDX, SIZE, null_safe_join, salted_lookup, with_row_index
from gustline.operators.boosting import BoostedModel, score_boosted
from gustline.operators.clean import contract_select
from gustline.operators.splits import latest_rows
from gustline.session import ensure_checkpoint_dir
from gustline.spec import FORECAST_SPEC, FeatureSpec, LinearModel

if TYPE_CHECKING:
    from gustline.sources.models import Artefacts

HORIZON = 72
CHECKPOINT_EVERY = 12


def _linear(model: LinearModel, value: Callable[[str], Column]) -> Column:
    out = F.lit(model.intercept)
    for i, name in enumerate(model.contract.features):
        x = value(name).cast("double")
        if model.contract.requires_scaling:
            if model.means is None or model.stds is None:
                raise RuntimeError(f"model {model.contract.model_name} scales its inputs, but has no means and deviations")
            x = (x - F.lit(model.means[i])) / F.lit(model.stds[i])
        out = out + F.lit(model.coefs[i]) * x
    return out


def score_linear(df: DataFrame, model: LinearModel, name: str = "predicted") -> DataFrame:
    """Contract-checked scoring as one expression, inside generated code."""
    contract_select(df, model.contract)
    return df.withColumn(name, _linear(model, F.col))


def backtest(df: DataFrame, model: LinearModel, series_cols: Sequence[str], n: int = HORIZON,
             digits: int = 2) -> DataFrame:
    """Actual and predicted value of the last ``n`` rows per series, rounded."""
    recent = score_linear(latest_rows(df, series_cols, n), model)
    return recent.select(*series_cols, "datetime",
                         F.round(model.contract.target, digits).alias("actual_pm25"),
                         F.round("predicted", digits).alias("predicted_pm25"))


def last_values(history: DataFrame, series_cols: Sequence[str], n: int, target: str) -> DataFrame:
    """The last ``n`` target values per series as an array, oldest first."""
    tail = with_row_index(history.select(*series_cols, "datetime", target), series_cols) \
        .where(F.col(IDX) > F.col(SIZE) - n)
    return (tail.groupBy(*series_cols)      # at most n values per series
            .agg(F.array_sort(F.collect_list(F.struct(IDX, F.col(target).alias("v")))).alias("_h"))
            .select(*series_cols, F.col("_h.v").alias("history")))


def _from_history(past: Column, spec: FeatureSpec) -> dict[str, Column]:
    """Lag and rolling features of the next step out of the array of past values."""
    lag, mean, std = spec.prefixes
    size = F.size(past)

    def window(n: int) -> Column:
        return F.slice(past, F.greatest(size - n + 1, F.lit(1)), F.lit(n))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    out = {}
    for n in spec.lags:
        out[f"{lag}{n}"] = F.when(size >= n, F.get(past, size - n)).otherwise(F.get(past, size - 1))
    for n in spec.means:
        out[f"{mean}{n}"] = total(window(n)) / F.size(window(n))
    for n in spec.stds:
        m, count = total(window(n)) / F.size(window(n)), F.size(window(n))
        squares = F.aggregate(window(n), F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
        out[f"{std}{n}"] = F.when(count > 1, F.sqrt(squares / (count - 1))).otherwise(F.lit(0.0))
    return out


def _needed(spec: FeatureSpec, features: Sequence[str]) -> FeatureSpec:
    """The part of the specification the contract uses."""
    own = FeatureSpec.from_columns(list(features), spec.target, spec.mode)
    for have, want, what in ((spec.lags, own.lags, "lag"), (spec.means, own.means, "mean"),
                             (spec.stds, own.stds, "std")):
        extra = set(want) - set(have)
        if extra:
            raise ValueError(f"the forecast specification lacks the {what} features {sorted(extra)}")
    return own


def _future_with_calendar(future: DataFrame, features: Sequence[str], spec: FeatureSpec) -> DataFrame:
    rows = add_time_features(future)
    derived = set(spec.columns)
    lacking = [c for c in features if c not in rows.columns and c not in derived]
    if lacking:
        raise ValueError(f"the future rows have no columns for {lacking}")
    return rows


def _finish(rows: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    return rows.select(
        *series_cols, F.col("step").alias("hour"), "datetime", F.round("yhat", 2).alias("predicted_pm25"),
        pm25_category("yhat", null_label="Hazardous").alias("category"),
        pm25_category("yhat", part=3).alias("status"))


def forecast_linear(history: DataFrame, future: DataFrame, model: LinearModel, series_cols: Sequence[str],
                    spec: FeatureSpec = FORECAST_SPEC) -> DataFrame:
    """Recursive forecast: each step sees the predictions before it.

    ``future`` holds the rows after the history with ``step`` 1, 2, … (at most the horizon).
    The steps of a series are a fold over its future rows; series run in parallel, without
    Python and without a pass per step.
    """
    features = model.contract.features
    spec = _needed(spec, features)
    future = _future_with_calendar(future, features, spec)
    carried = [c for c in features if c not in spec.columns]
    ahead = future.groupBy(*series_cols).agg(       # at most the horizon per series
        F.array_sort(F.collect_list(F.struct("step", "datetime", *carried))).alias("_ahead"))
    rows = null_safe_join(ahead, last_values(history, series_cols, spec.lookback, model.contract.target), series_cols)

    def step(past: Column, row: Column) -> Column:
        derived = _from_history(past, spec)
        yhat = _linear(model, lambda c: derived[c] if c in derived else row[c])
        return F.concat(past, F.array(yhat))

    # the fold keeps the whole path: the last H values are the predictions
    path = F.aggregate("_ahead", F.col("history"), step)
    return _finish(
        rows.withColumn("_path", F.slice(path, F.size("history") + 1, F.size("_ahead")))
        .select(*series_cols, F.inline(F.arrays_zip(F.col("_ahead").alias("row"), F.col("_path").alias("yhat"))))
        .select(*series_cols, "row.step", "row.datetime", "yhat"), series_cols)


Predict = Callable[[np.ndarray, "pa.RecordBatch"], np.ndarray]


def forecast_in_one_pass(history: DataFrame, future: DataFrame, predict: Predict, features: Sequence[str], series_cols: Sequence[str],
                         spec: FeatureSpec = FORECAST_SPEC, target: str = "pm25", carried: DataFrame | None = None) -> DataFrame:
    """Recursive forecast with a model that is at hand as arrays: all steps of a series in one task, without a pass per step.

    ``predict(x, series)`` gives the predictions for the rows of a matrix of features; ``series`` holds one row per row of it,
    with the columns of ``carried``, a table with one row per series (such as coefficients). A series is at most the horizon of
    future rows and its look-back; a batch of series is stepped together.
    """
    spec = _needed(spec, features)
    future = _future_with_calendar(future, features, spec)
    derived = set(spec.columns)
    known = [c for c in features if c not in derived]
    ahead = future.groupBy(*series_cols).agg(       # at most the horizon per series
        F.array_sort(F.collect_list(F.struct("step", "datetime", F.array(*[F.col(c).cast("double") for c in known]).cast("array<double>").alias("known")
                                             ))).alias("_ahead"))
    rows = null_safe_join(ahead, last_values(history, series_cols, spec.lookback, target), series_cols)
    if carried is not None:
        rows = null_safe_join(rows, carried, series_cols)
    lag, mean, std = spec.prefixes

    def value(past: list[float], name: str) -> float:
        n = int(name.rsplit("_", 1)[1])
        if name.startswith(lag):
            return past[-n] if len(past) >= n else past[-1]
        window = np.array(past[-n:])
        if name.startswith(mean):
            return float(window.mean())
        return float(window.std(ddof=1)) if len(window) > 1 else 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pasts = batch.column("history").to_pylist()
            given = [[a["known"] for a in row] for row in batch.column("_ahead").to_pylist()]
            out: list[list[float]] = [[] for _ in pasts]
            for step in range(max(map(len, given), default=0)):
                live = [i for i, row in enumerate(given) if step < len(row)]
                x = np.empty((len(live), len(features)))
                for place, i in enumerate(live):
                    exact = iter(given[i][step])
                    x[place] = [value(pasts[i], c) if c in derived else np.nan if (v := next(exact)) is None else v for c in features]
                for i, y in zip(live, predict(x, batch.take(pa.array(live))).tolist(), strict=True):
                    out[i].append(y)
                    pasts[i].append(y)
            names = [*series_cols, "_ahead"]
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(out, pa.list_(pa.float64()))], names=[*names, "_path"])

    schema = rows.select(*series_cols, "_ahead", F.array().cast("array<double>").alias("_path")).schema
    done = rows.mapInArrow(work, schema)
    return _finish(done.select(*series_cols, F.inline(F.arrays_zip(F.col("_ahead").alias("row"), F.col("_path").alias("yhat"))))
                   .select(*series_cols, "row.step", "row.datetime", "yhat"), series_cols)


def forecast_trees(history: DataFrame, future: DataFrame, model: BoostedModel, series_cols: Sequence[str],
                   spec: FeatureSpec = FORECAST_SPEC, target: str = "pm25") -> DataFrame:
    """Recursive forecast with an ensemble of trees, in one pass over the series."""
    return forecast_in_one_pass(history, future, lambda x, _: model.predict(x), model.features, series_cols, spec, target)


def forecast_with_model(history: DataFrame, future: DataFrame, predict: Callable[[DataFrame], DataFrame],
                        features: Sequence[str], series_cols: Sequence[str], horizon: int = HORIZON,
                        spec: FeatureSpec = FORECAST_SPEC, target: str = "pm25") -> DataFrame:
    """Recursive forecast with any model (``predict`` adds ``predicted``).

    One pass per step over one row per series; the lineage is cut every few steps.
    """
    ensure_checkpoint_dir(history.sparkSession)
    spec = _needed(spec, features)
    future = _future_with_calendar(future, features, spec)
    keep = spec.lookback
    carried = [c for c in features if c not in spec.columns]
    ahead = future.groupBy(*series_cols).agg(
        F.array_sort(F.collect_list(F.struct("step", "datetime", *carried))).alias("_ahead"))
    state = (null_safe_join(ahead, last_values(history, series_cols, keep, target), series_cols)
             .withColumn("_out", F.array().cast("array<double>"))).checkpoint()
    for step in range(1, horizon + 1):
        row = F.get("_ahead", F.lit(step - 1))
        live = row.isNotNull()      # a series may have fewer future rows than the horizon
        values = {**_from_history(F.col("history"), spec), **{c: row[c] for c in carried}}
        inputs = state.withColumns({c: F.when(live, v).otherwise(F.lit(0.0)) for c, v in values.items()})
        yhat = F.array("predicted")
        state = predict(inputs).select(
            *series_cols, "_ahead",
            F.when(live, F.slice(F.concat("history", yhat), F.greatest(F.size("history") + 2 - keep, F.lit(1)),
                                 F.lit(keep))).otherwise(F.col("history")).alias("history"),
            F.when(live, F.concat("_out", yhat)).otherwise(F.col("_out")).alias("_out"))
        if step % CHECKPOINT_EVERY == 0:
            state = state.checkpoint()
    rows = state.select(*series_cols, F.inline(F.arrays_zip(
        F.slice("_ahead", 1, F.size("_out")).alias("row"), F.col("_out").alias("yhat"))))
    return _finish(rows.select(*series_cols, "row.step", "row.datetime", "yhat"), series_cols)


def _linear_rows(artefacts: "Artefacts", series_cols: Sequence[str]) -> DataFrame:
    """Series with a linear contract and their coefficients, by name of the feature."""
    chosen = artefacts.contract.select(*series_cols, F.col("model_name").alias("model"))
    return null_safe_join(artefacts.linear, chosen, [*series_cols, "model"]).select(
        *series_cols, F.map_from_arrays("features", "slopes").alias("_slopes"), "bias")


def _chosen(df: DataFrame, artefacts: "Artefacts", series_cols: Sequence[str]) -> DataFrame:
    return salted_lookup(df, artefacts.contract.select(*series_cols, "model_name"), [*series_cols])


def score_promoted(df: DataFrame, artefacts: "Artefacts", series_cols: Sequence[str]) -> DataFrame:
    """Score every series with the model its contract names; ``model_name`` says which. Series without a contract are left out."""
    rows, out = _chosen(df, artefacts, series_cols), None
    shared = list(artefacts.ensembles)
    for name, model in artefacts.ensembles.items():
        mine = rows.where(F.col("model_name") == name)
        pipeline = artefacts.pipelines.get(name)
        part = pipeline.transform(mine).drop("features") if pipeline is not None else score_boosted(mine, model)
        out = part if out is None else out.unionByName(part)
    if artefacts.linear is not None:
        mine = salted_lookup(rows.where(~F.col("model_name").isin(shared)), _linear_rows(artefacts, series_cols), [*series_cols])
        names = sorted({c for r in artefacts.contract.select(F.explode("features").alias("f")).distinct().collect() for c in [r["f"]]})
        terms = [F.coalesce(F.col("_slopes")[c] * F.col(c).cast("double"), F.lit(0.0)) for c in names if c in df.columns]
        part = mine.withColumn("predicted", sum(terms, F.col("bias"))).drop("_slopes", "bias")
        out = part if out is None else out.unionByName(part)
    return out


def forecast_promoted(history: DataFrame, future: DataFrame, artefacts: "Artefacts", series_cols: Sequence[str],
                      spec: FeatureSpec = FORECAST_SPEC, target: str = "pm25") -> DataFrame:
    """The recursive forecast of every series with the model its contract names, one pass per kind of model."""
    history, future = (_chosen(df, artefacts, series_cols) for df in (history, future))
    out = None

    def of(df: DataFrame, condition: Column) -> DataFrame:
        return df.where(condition).drop("model_name")

    for name, model in artefacts.ensembles.items():
        mine = F.col("model_name") == name
        part = forecast_trees(of(history, mine), of(future, mine), model, series_cols, spec, target)
        out = part if out is None else out.unionByName(part)
    if artefacts.linear is not None:
        mine = ~F.col("model_name").isin(list(artefacts.ensembles))
        models = _linear_rows(artefacts, series_cols)
        names = sorted({r["f"] for r in models.select(F.explode(F.map_keys("_slopes")).alias("f")).distinct().collect()})    # columns
        if names:
            weights = models.select(*series_cols, F.array(*[F.coalesce(F.col("_slopes")[c], F.lit(0.0)) for c in names]).alias("_w"), "bias")

            def predict(x: np.ndarray, series: pa.RecordBatch) -> np.ndarray:
                w = series.column("_w").flatten().to_numpy().reshape(len(series), -1)
                return (np.where(w == 0, 0.0, x) * w).sum(axis=1) + series.column("bias").to_numpy()

            part = forecast_in_one_pass(of(history, mine), of(future, mine), predict, names, series_cols, spec, target, weights)
            out = part if out is None else out.unionByName(part)
    return out

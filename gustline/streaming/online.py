"""Online lag and rolling features with keyed state: the last values of every series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gustline.spec import FeatureSpec

_STATE = T.StructType([T.StructField("last", T.LongType()),
                       T.StructField("values", T.ArrayType(T.DoubleType()))])


def _looking_back(path: np.ndarray, start: int, n: int) -> np.ndarray:
    """Row k: the ``n`` values before place ``start`` + k of the path; NaN where the path does not reach back so far."""
    padded = np.r_[np.full(n, np.nan), path]
    return np.lib.stride_tricks.sliding_window_view(padded, n)[start:len(path)]


def online_features(stream: DataFrame, spec: FeatureSpec, series_cols: Sequence[str], ts: str = "datetime"
                    ) -> DataFrame:
    """Strict features of every arriving hour, from the state alone.

    The state of a series is the look-back (a fixed number of values). An hour that is not
    after the last one seen is passed on with ``late`` set and without features: the upsert
    path recomputes it.
    """
    if spec.mode != "strict":
        raise ValueError("online features are the strict ones")
    keep = spec.lookback
    lag, mean, std = spec.prefixes
    fields = [f for f in stream.schema.fields if f.name in (*series_cols, ts, spec.target)]
    out = T.StructType([*fields, T.StructField("late", T.BooleanType()),
                        *[T.StructField(c, T.DoubleType()) for c in spec.columns]])
    names = [f.name for f in fields]

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, values = state.get if state.exists else (None, [])
        # the rows of one micro-batch, whose size the source limits
        rows = pd.concat([c[names] for c in chunks], ignore_index=True).sort_values(ts, kind="stable", ignore_index=True)
        at = rows[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        late = np.r_[last is not None and at[0] <= last, at[1:] == at[:-1]]
        if last is not None:
            late |= at <= last
        # the state, then the new hours in order; place k of the new ones sees path[:start + k]
        fresh = rows.loc[~late, spec.target].to_numpy(float)
        past = np.array([np.nan if v is None else v for v in values], float)
        path, start = np.r_[past, fresh], len(past)
        columns = {}
        for n in spec.lags:
            columns[f"{lag}{n}"] = _looking_back(path, start, n)[:, 0]
        for n, prefix, measure in ([(n, mean, lambda w: w.mean(axis=1)) for n in spec.means]
                                   + [(n, std, lambda w: w.std(axis=1, ddof=1) if w.shape[1] > 1 else np.full(len(w), np.nan)) for n in spec.stds]):
            columns[f"{prefix}{n}"] = measure(_looking_back(path, start, n))
        found = pd.DataFrame(np.nan, index=rows.index, columns=spec.columns)
        found.loc[~late] = np.column_stack([columns[c] for c in spec.columns]) if len(fresh) else found.loc[~late]
        if len(fresh):
            last = int(at[~late][-1])
        state.update((last, [None if np.isnan(v) else float(v) for v in path[-keep:]]))
        yield rows.assign(late=late, **{c: found[c] for c in spec.columns})[out.fieldNames()]

    return stream.groupBy(*series_cols).applyInPandasWithState(
        step, out, _STATE, "append", GroupStateTimeout.NoTimeout)

"""Ridge and lasso with expanding-window cross-validation for many series at once.

The rows are read once: each series is cut where any (outer or inner) fold begins or ends, and
one aggregation gives counts, sums and cross products per stretch. Those add up, so the
statistics of every training and validation set follow without touching a row again. What is
left per series is a system of a few equations, solved next to the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.operators.blocks import IDX, SIZE, salted_lookup, with_row_index
from gustline.operators.selection import LINEAR_K, MUST_HAVE
from gustline.operators.splits import FIXED_HOLDOUT, holdout_size

# Penalties that are tried.
RIDGE_ALPHAS = [0.01, 0.1, 1.0, 10.0, 50.0, 100.0, 500.0]
LASSO_ALPHAS = [0.001, 0.01, 0.1, 1.0]
LASSO_FOLDS = 5


def fold_ends(n: int, k: int) -> list[int]:
    """Ends of the k expanding training sets over n rows (the last one is followed by n)."""
    step = n // (k + 1)
    return [n - (k + 1 - i) * step for i in range(1, k + 1)]


def _ends(n: Column, k: int) -> list[Column]:
    step = F.floor(n / F.lit(k + 1))
    return [n - (k + 1 - i) * step for i in range(1, k + 1)]


def _cuts(dev: Column, k: int, inner: int) -> Column:
    """All positions at which some training or validation set of the development rows ends."""
    outer = [*_ends(dev, k), dev]
    nested = [e for t in outer for e in _ends(t, inner)] if inner else []
    return F.array(*outer, *nested)


def gram_blocks(df: DataFrame, y: str, cols: Sequence[str], series_cols: Sequence[str],
                test_size: Column, k: int, inner: int) -> DataFrame:
    """Sufficient statistics per (series, stretch between two cuts).

    Values are taken relative to the mean of the series, so that squares do not cancel. The
    sums have partial results before the shuffle; a long series is no hot key.
    """
    names = [*cols, y]
    rows = with_row_index(df.na.drop("any", subset=names), series_cols,
                          totals={f"_tot_{c}": F.col(c).cast("double") for c in names})
    dev = F.col(SIZE) - test_size
    cuts = F.filter(_cuts(dev, k, inner), lambda c: c >= F.col(IDX))
    centred = rows.select(
        *series_cols, F.col(SIZE).alias("n_rows"), dev.alias("n_dev"),
        F.coalesce(F.array_min(cuts), F.col(SIZE)).alias("upto"),
        *[(F.col(f"_tot_{c}") / F.col(SIZE)).alias(f"_mean_{c}") for c in names],
        *[(F.col(c) - F.col(f"_tot_{c}") / F.col(SIZE)).alias(f"_x{i}") for i, c in enumerate(names)])
    p = len(names)
    # as text: a wide table has hundreds of products
    sums = ", ".join(f"sum(_x{i})" for i in range(p))
    cross = ", ".join(f"sum(_x{i} * _x{j})" for i in range(p) for j in range(i, p))
    return centred.groupBy(*series_cols, "n_rows", "n_dev", "upto").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"array({sums}) AS sums"), F.expr(f"array({cross}) AS cross"),
        F.array(*[F.first(f"_mean_{c}") for c in names]).alias("offsets"))


class _Moments:
    """Count, sums and cross products of one set of rows; the target is the last variable."""

    def __init__(self, n: float, s: np.ndarray, c: np.ndarray):
        self.n, self.s, self.c = n, s, c

    @property
    def mean(self) -> np.ndarray:
        return self.s / self.n

    def about(self, centre: np.ndarray) -> np.ndarray:
        return self.c - np.outer(centre, self.s) - np.outer(self.s, centre) + self.n * np.outer(centre, centre)

    def errors(self, v: np.ndarray, pick: np.ndarray, centre: np.ndarray) -> tuple[float, float]:
        """(RMSE, R²) of yhat = centre_y + v'(x - centre_x) on these rows."""
        m = self.about(centre)
        sse = max(0.0, m[-1, -1] - 2 * v @ m[pick, -1] + v @ m[np.ix_(pick, pick)] @ v)
        spread = self.about(self.mean)[-1, -1]
        return (sse / self.n) ** 0.5, (1 - sse / spread if spread > 0 else float("nan"))


class _Series:
    """Stretches of one series; any range of rows between two cuts is a sum of stretches."""

    def __init__(self, blocks: Sequence, p: int):
        upper = np.triu_indices(p)
        self.blocks = []
        for b in blocks:
            c = np.zeros((p, p))
            c[upper] = b["cross"]
            c = c + np.triu(c, 1).T
            self.blocks.append((int(b["upto"]), float(b["n"]), np.asarray(b["sums"], float), c))

    def between(self, start: int, end: int) -> _Moments:
        part = [b for b in self.blocks if start < b[0] <= end]
        return _Moments(sum(b[1] for b in part), sum(b[2] for b in part), sum(b[3] for b in part))


def _ridge(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float) -> np.ndarray:
    return np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)


def _lasso(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float, rounds: int = 10_000,
           tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent on 1/(2n) |y - Xw|² + alpha |w|₁ (Friedman et al., 2010)."""
    g, c = xx / n, xy / n
    w = np.zeros(len(c))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(c)):
            if g[j, j] <= 0:
                continue
            rest = c[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / g[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol:
            break
    return w


def _select(train: _Moments, cols: list[str], k: int, must_have: Sequence[str]) -> np.ndarray:
    """Column numbers: the k best by univariate F in column order, then the must-haves."""
    c = train.about(train.mean)
    spread = np.sqrt(np.maximum(np.diag(c), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = c[:-1, -1] / (spread[:-1] * spread[-1])
    score = np.where(np.isfinite(r), r * r, -1.0)       # F grows with r²
    best = np.argsort(score, kind="stable")[::-1][:k]
    chosen = sorted(int(i) for i in best)
    return np.array(chosen + [cols.index(m) for m in must_have if m in cols and cols.index(m) not in chosen])


def _scales(train: _Moments, pick: np.ndarray) -> np.ndarray:
    var = np.diag(train.about(train.mean))[pick] / train.n
    return np.where(var > 1e-24, np.sqrt(np.maximum(var, 0)), 1.0)


def _tune(series: _Series, end: int, pick: np.ndarray, scale: np.ndarray, alphas: Sequence[float],
          k: int, solve, by_r2: bool) -> float:
    """Penalty with the best mean validation score over k inner folds of the rows up to ``end``."""
    scores = np.zeros(len(alphas))
    step = end // (k + 1)
    for stop in fold_ends(end, k):
        train, val = series.between(0, stop), series.between(stop, stop + step)
        c = train.about(train.mean)
        xx = c[np.ix_(pick, pick)] / np.outer(scale, scale)
        xy = c[pick, -1] / scale
        for i, alpha in enumerate(alphas):
            rmse, r2 = val.errors(solve(xx, xy, train.n, alpha) / scale, pick, train.mean)
            scores[i] += r2 if by_r2 else -rmse
    return float(alphas[int(np.argmax(scores))])


def _fit(series: _Series, end: int, pick: np.ndarray, scale: np.ndarray, alpha: float, solve):
    train = series.between(0, end)
    c = train.about(train.mean)
    w = solve(c[np.ix_(pick, pick)] / np.outer(scale, scale), c[pick, -1] / scale, train.n, alpha)
    return train, w


MODEL_SCHEMA = T.StructType([
    T.StructField("fold", T.IntegerType()),
    T.StructField("alpha", T.DoubleType()),
    T.StructField("n_train", T.LongType()),
    T.StructField("n_val", T.LongType()),
    T.StructField("train_rmse", T.DoubleType()),
    T.StructField("val_rmse", T.DoubleType()),
    T.StructField("train_r2", T.DoubleType()),
    T.StructField("val_r2", T.DoubleType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("coefs", T.ArrayType(T.DoubleType())),
    T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("stds", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("slopes", T.ArrayType(T.DoubleType())),
    T.StructField("bias", T.DoubleType()),
])


def _record(fold: int, alpha: float, train: _Moments, val: _Moments, w: np.ndarray, pick: np.ndarray,
            scale: np.ndarray, cols: list[str], offsets: np.ndarray) -> dict:
    v = w / scale
    train_rmse, train_r2 = train.errors(v, pick, train.mean)
    val_rmse, val_r2 = val.errors(v, pick, train.mean) if val.n else (float("nan"), float("nan"))
    means = train.mean + offsets
    slopes = np.zeros(len(cols))
    slopes[pick] = v

    def r4(x: float):
        return None if not np.isfinite(x) else round(float(x), 4)

    return {
        "fold": fold, "alpha": alpha, "n_train": int(train.n), "n_val": int(val.n),
        "train_rmse": r4(train_rmse), "val_rmse": r4(val_rmse), "train_r2": r4(train_r2), "val_r2": r4(val_r2),
        "ratio": r4(val_rmse / train_rmse) if train_rmse > 0 else None,
        "features": [cols[i] for i in pick], "coefs": w.tolist(), "means": means[pick].tolist(),
        "stds": scale.tolist(), "intercept": float(means[-1]),
        "slopes": slopes.tolist(), "bias": float(means[-1] - v @ means[pick]),
    }


def _ridge_series(blocks, n_rows: int, n_dev: int, cols: list[str], offsets: np.ndarray, k: int, inner: int,
                  top: int, must_have: Sequence[str], alphas: Sequence[float]) -> Iterator[dict]:
    series = _Series(blocks, len(cols) + 1)
    step = n_dev // (k + 1)
    plan = [(i, end, end + step) for i, end in enumerate(fold_ends(n_dev, k), 1)]
    for fold, end, stop in [*plan, (0, n_dev, n_rows)]:
        train = series.between(0, end)
        pick = _select(train, cols, top, must_have)
        scale = _scales(train, pick)
        alpha = _tune(series, end, pick, scale, alphas, inner, _ridge, by_r2=False)
        train, w = _fit(series, end, pick, scale, alpha, _ridge)
        yield _record(fold, alpha, train, series.between(end, stop), w, pick, scale, cols, offsets)


def _lasso_series(blocks, n_rows: int, n_dev: int, cols: list[str], offsets: np.ndarray, k: int,
                  alphas: Sequence[float]) -> Iterator[dict]:
    series = _Series(blocks, len(cols) + 1)
    pick = np.arange(len(cols))
    scale = _scales(series.between(0, n_dev), pick)
    alpha = _tune(series, n_dev, pick, scale, alphas, k, _lasso, by_r2=True)
    train, w = _fit(series, n_dev, pick, scale, alpha, _lasso)
    yield _record(0, alpha, train, series.between(n_dev, n_rows), w, pick, scale, cols, offsets)


def _per_series(blocks: DataFrame, cols: Sequence[str], series_cols: Sequence[str], min_dev: int, solve
                ) -> DataFrame:
    # one row per series with a handful of stretches: the number of cuts is fixed by the folds
    packed = (blocks.where(F.col("n_dev") >= min_dev).groupBy(*series_cols, "n_rows", "n_dev")
              .agg(F.collect_list(F.struct("upto", "n", "sums", "cross")).alias("blocks"),
                   F.first("offsets").alias("offsets")))
    names = list(cols)
    out = [f for f in packed.schema.fields if f.name in series_cols]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                head = {c: row[c] for c in series_cols}
                offsets = np.asarray(row["offsets"], float)
                rows += [{**head, **r} for r in
                         solve(row["blocks"], int(row["n_rows"]), int(row["n_dev"]), names, offsets)]
            if rows:
                yield pd.DataFrame(rows)

    return packed.mapInPandas(run, T.StructType(out + MODEL_SCHEMA.fields))


def ridge_cv(df: DataFrame, y: str, cols: Sequence[str], series_cols: Sequence[str],
             alphas: Sequence[float] = tuple(RIDGE_ALPHAS), k: int = 3, inner: int = 3,
             top: int = LINEAR_K, must_have: Sequence[str] = tuple(MUST_HAVE)) -> DataFrame:
    """Ridge per series with nested selection, scaling and penalty search.

    One row per fold (1..k) and one, fold 0, for the final model on all development rows, whose
    validation side is the holdout.
    """
    blocks = gram_blocks(df, y, cols, series_cols, holdout_size(F.col(SIZE)), k, inner)

    def solve(b, n_rows, n_dev, names, offsets):
        return _ridge_series(b, n_rows, n_dev, names, offsets, k, inner, top, must_have, alphas)

    return _per_series(blocks, cols, series_cols, (k + 1) * (inner + 1), solve)


def lasso_cv(df: DataFrame, y: str, cols: Sequence[str], series_cols: Sequence[str],
             alphas: Sequence[float] = tuple(LASSO_ALPHAS), k: int = LASSO_FOLDS,
             test_rows: int = FIXED_HOLDOUT) -> DataFrame:
    """Lasso per series; the penalty has the best mean R² over k folds, the test set is the
    last ``test_rows`` rows."""
    blocks = gram_blocks(df, y, cols, series_cols, F.lit(test_rows), k, 0)

    def solve(b, n_rows, n_dev, names, offsets):
        return _lasso_series(b, n_rows, n_dev, names, offsets, k, alphas)

    return _per_series(blocks, cols, series_cols, 2 * (k + 1), solve)


def score_models(df: DataFrame, models: DataFrame, cols: Sequence[str], series_cols: Sequence[str],
                 name: str = "predicted") -> DataFrame:
    """Predictions of one linear model per series (``slopes`` over ``cols`` and ``bias``)."""
    joined = salted_lookup(df, models.select(*series_cols, "slopes", "bias"), [*series_cols])
    terms = [F.col(c) * F.col("slopes")[i] for i, c in enumerate(cols)]
    return joined.withColumn(name, sum(terms, F.col("bias"))).drop("slopes", "bias")


def coef_ranking(models: DataFrame, by: Sequence[str], nonzero: bool = False) -> DataFrame:
    """Coefficients per model, largest magnitude first (``nonzero``: only those, by value)."""
    pairs = models.select(*by, F.inline(F.arrays_zip(F.col("features").alias("feature"),
                                                     F.col("coefs").alias("coef"))))
    if nonzero:
        return pairs.where(F.col("coef") != 0).orderBy(*by, F.desc("coef"))
    return pairs.withColumn("abs_coef", F.abs("coef")).orderBy(*by, F.desc("abs_coef"), "feature")


def ridge_two(df: DataFrame, y: str, cols: Sequence[str], alpha: float, by: Sequence[str]) -> DataFrame:
    """Closed-form ridge on two standardised features, in SQL aggregates only."""
    a, b = cols
    n = F.count(F.lit(1))
    stats = df.groupBy(*by).agg(
        n.alias("n"), F.corr(a, b).alias("rab"),
        F.covar_pop(a, y).alias("cay"), F.covar_pop(b, y).alias("cby"),
        F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.avg(y).alias("intercept"))
    n_ = F.col("n")
    diag, off = n_ + F.lit(alpha), n_ * F.col("rab")
    ya, yb = n_ * F.col("cay") / F.col("sa"), n_ * F.col("cby") / F.col("sb")
    det = diag * diag - off * off
    return stats.select(*by, "n", "intercept",
                        ((diag * ya - off * yb) / det).alias(f"coef_{a}"),
                        ((diag * yb - off * ya) / det).alias(f"coef_{b}"))

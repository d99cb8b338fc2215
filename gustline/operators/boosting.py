"""Boosted regression trees with penalties, fitted in segments, several fits side by side.

Columns are binned once and rows packed into stored blocks. Squared loss is additive, so a fit goes on from residuals. A segment is
``segment`` trees: their splits are grown together, level by level, each on its own sample of rows and columns, from histograms of the
residuals before the segment. One more pass sums, for all pairs of leaves, the rows in both, and per leaf the residuals; from these the driver
computes the leaf values one tree after the other, each tree on what the trees before it left over, and the loss on the validation rows
after every tree. So leaf values and early stopping are those of trees fitted one by one, only the splits see residuals that are up to a
segment old. A segment costs depth + 1 jobs, whatever the number of rows, and the fits of all folds share them.

What travels to the driver are sums whose size depends on trees, columns and bins alone. Residuals are written every ``STORE_EVERY``
segments; between, tasks add the newer trees to the stored ones.

Rows need all columns; rows where one is null or not finite do not take part in a fit and are scored with null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.session import materialise

BLOCK_ROWS = 8192
STORE_EVERY = 10
TRAIN, VAL = 1, 2
Array = np.ndarray


@dataclass(frozen=True)
class BoostParams:
    """``trees`` is the ceiling; ``leaves`` limits the leaves of a tree, which then keeps its best splits first."""

    step: float = 0.02
    depth: int = 2
    leaves: int | None = None
    subsample: float = 0.6
    colsample: float = 0.5
    min_child: float = 20.0
    l1: float = 3.0
    l2: float = 15.0
    gamma: float = 1.0
    patience: int = 50
    trees: int = 4000
    bins: int = 64
    segment: int = 50
    seed: int = 42


# Parameters of the two boosted models.
BOOST_A = BoostParams()
BOOST_B = BoostParams(depth=3, leaves=7, gamma=0.0)


@dataclass
class BoostedModel:
    """An ensemble as arrays: complete trees, node i splits into 2i + 1 and 2i + 2, a row goes left where its value is at most the threshold.

    A node that does not split has an infinite threshold, so its rows go left; ``value`` and ``cover`` (training rows) belong to the
    leaves, ``share`` (of the rows of the sample) is derived for attribution.
    """

    features: list[str]
    base: float
    feature: Array = field(default_factory=lambda: np.zeros((0, 3), np.int32))
    threshold: Array = field(default_factory=lambda: np.zeros((0, 3)))
    value: Array = field(default_factory=lambda: np.zeros((0, 4)))
    cover: Array = field(default_factory=lambda: np.zeros((0, 4)))
    losses: list[float] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 1

    def first(self, trees: int) -> BoostedModel:
        """The model of the first ``trees`` trees."""
        return replace(self, feature=self.feature[:trees], threshold=self.threshold[:trees], value=self.value[:trees],
                       cover=self.cover[:trees])

    def leaves_of(self, x: Array) -> Array:
        """Leaf numbers (rows x trees) for a matrix of column values."""
        return _walk(x, self.feature, self.threshold)

    def predict(self, x: Array) -> Array:
        out = np.full(len(x), self.base)
        for at in range(0, len(self.value), 500):       # bounds memory
            part = slice(at, at + 500)
            leaves = _walk(x, self.feature[part], self.threshold[part])
            out += np.take_along_axis(self.value[part].T, leaves, axis=0).sum(axis=1)
        return out

    def importances(self) -> Array:
        """Share of every column in what the splits gain, by the spread of leaf values under each split."""
        gain = np.zeros(len(self.features))
        weight, mean = self.cover, self.value
        for level in range(self.depth - 1, -1, -1):
            pairs, means = weight.reshape(len(weight), -1, 2), mean.reshape(len(mean), -1, 2)
            weight = pairs.sum(axis=2)
            mean = np.divide((pairs * means).sum(axis=2), weight, out=np.zeros_like(weight), where=weight > 0)
            spread = (pairs * (means - mean[:, :, None]) ** 2).sum(axis=2)
            first = 2 ** level - 1
            np.add.at(gain, self.feature[:, first:2 * first + 1].ravel(), spread.ravel())
        return gain / gain.sum() if gain.sum() > 0 else gain


def _walk(x: Array, feature: Array, threshold: Array) -> Array:
    depth = (feature.shape[1] + 1).bit_length() - 1
    trees = np.arange(len(feature))
    node = np.zeros((len(x), len(feature)), np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(depth):
        right = x[rows, feature[trees, node]] > threshold[trees, node]
        node = 2 * node + 1 + right
    return node - feature.shape[1]


# -- stored blocks ----------------------------------------------------------------------------
def complete(cols: Sequence[str]) -> Column:
    """Whether all columns hold finite numbers."""
    return functools.reduce(lambda a, b: a & b, [
        F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in cols])


def bin_borders(df: DataFrame, cols: Sequence[str], bins: int) -> list[Array]:
    """Ascending thresholds of each column at approximate quantiles; bin b holds values above threshold b - 1 and up to threshold b."""
    cuts = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), cuts, 100 * bins).alias(c) for c in cols]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in cols]


BLOCKS = "block long, y binary, bins binary, roles binary, residual binary"


def blocks_of(rows: DataFrame, y: str, cols: Sequence[str], borders: list[Array], base: Array) -> DataFrame:
    """Rows with ``roles`` (one number per fit: 0 none, 1 train, 2 validation) as stored blocks of binned columns and residuals."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                target = part.column("y").to_numpy()
                x = [np.searchsorted(b, part.column(f"x{i}").to_numpy(), side="left") for i, b in enumerate(borders)]
                roles = part.column("roles").flatten().to_numpy().reshape(len(part), -1).T
                yield pa.record_batch({
                    "block": pa.array([number]), "y": pa.array([target.tobytes()], pa.binary()),
                    "bins": pa.array([np.stack(x).astype(np.int16).tobytes()], pa.binary()),
                    "roles": pa.array([np.ascontiguousarray(roles, np.int8).tobytes()], pa.binary()),
                    "residual": pa.array([(target[None, :] - base[:, None]).tobytes()], pa.binary())})
                number += 1

    packed = rows.where(complete([y, *cols])).select(
        F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], "roles")
    return materialise(packed.mapInArrow(work, BLOCKS), "boosting-blocks")


@dataclass
class Block:
    """One block inside a task."""

    number: int
    y: Array
    bins: Array         # columns x rows
    roles: Array        # fits x rows
    residual: Array     # fits x rows

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[Block]:
        for i in range(len(batch)):
            get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
            y = get("y", float)
            yield cls(batch.column("block")[i].as_py(), y, get("bins", np.int16).reshape(-1, len(y)),
                      get("roles", np.int8).reshape(-1, len(y)), get("residual", float).reshape(-1, len(y)).copy())


@dataclass
class Grown:
    """The splits of some trees on binned columns, and their leaf values once they are known."""

    feature: Array      # trees x inner nodes
    cut: Array          # a row goes left where its bin is at most the cut
    value: Array | None = None

    def leaves(self, bins: Array) -> Array:
        return _walk(bins.T, self.feature, self.cut)

    def predicted(self, bins: Array) -> Array:
        return np.take_along_axis(self.value.T, self.leaves(bins), axis=0).sum(axis=1)


def _summed(parts: DataFrame) -> dict[int, Array]:
    """Sum of the vectors of all tasks by slot, on the driver; their size does not depend on the rows."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), float) for v in table.column("vector"))
        return pa.table({"slot": table.column("slot")[:1], "vector": pa.array([total.tobytes()], pa.binary())})

    rows = parts.groupBy("slot").applyInArrow(add, "slot int, vector binary").toArrow()
    return {s: np.frombuffer(v, float) for s, v in zip(rows.column("slot").to_pylist(), rows.column("vector").to_pylist(), strict=True)}


def _emit(sums: dict[int, Array]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.record_batch({"slot": pa.array(list(sums), pa.int32()), "vector": pa.array([v.tobytes() for v in sums.values()], pa.binary())})


class Sampler:
    """Which rows and columns a tree looks at; a repeated task draws the same."""

    def __init__(self, params: BoostParams, columns: list[list[int]]) -> None:
        self.params, self.columns = params, columns

    def rows(self, block: Block, fit: int, segment: int) -> Array:
        """(trees x rows) training rows in the sample of each tree of a segment."""
        rng = np.random.default_rng([self.params.seed, 7, fit, segment, block.number])
        return (rng.random((self.params.segment, len(block.y)), np.float32) < self.params.subsample) & (block.roles[fit] == TRAIN)

    def cols(self, fit: int, segment: int) -> Array:
        """(trees x sampled columns), numbers among all columns."""
        mine = self.columns[fit]
        some = max(1, int(self.params.colsample * len(mine)))
        rng = np.random.default_rng([self.params.seed, 11, fit, segment])
        return np.array([np.sort(rng.choice(mine, some, replace=False)) for _ in range(self.params.segment)])


def _apply(block: Block, pending: list[list[Grown]]) -> None:
    """Take the trees that were grown since the block was stored off its residuals."""
    for fit, segments in enumerate(pending):
        for grown in segments:
            block.residual[fit] -= grown.predicted(block.bins)


def _histograms(blocks: DataFrame, sampler: Sampler, segment: int, growing: dict[int, Grown], level: int,
                pending: list[list[Grown]], width: int) -> dict[int, Array]:
    """Per fit and tree: residual sums and rows by (node of the level, sampled column, bin)."""
    trees, nodes = sampler.params.segment, 2 ** level

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Array] = {}
        for batch in batches:
            for block in Block.read(batch):
                _apply(block, pending)
                for fit, grown in growing.items():
                    sample, cols = sampler.rows(block, fit, segment), sampler.cols(fit, segment)
                    inner = 2 ** level - 1
                    at = _walk(block.bins.T, grown.feature[:, :inner], grown.cut[:, :inner]) if level else np.zeros((len(block.y), trees), np.int64)
                    for t in range(trees):
                        rows = np.flatnonzero(sample[t])
                        base, r = at[rows, t] * width, block.residual[fit][rows]
                        found = np.empty((len(cols[t]), 2, nodes * width))
                        for i, c in enumerate(cols[t]):
                            spot = base + block.bins[c][rows]
                            found[i, 0] = np.bincount(spot, r, nodes * width)
                            found[i, 1] = np.bincount(spot, minlength=nodes * width)
                        slot = fit * trees + t
                        sums[slot] = sums[slot] + found.ravel() if slot in sums else found.ravel()
        yield from _emit(sums)

    return _summed(blocks.mapInArrow(work, "slot int, vector binary"))


def _shrunk(g: Array, l1: float) -> Array:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _best_splits(found: Array, params: BoostParams) -> tuple[Array, Array, Array]:
    """For each node: place of the best column, its bin, and the gain (-inf where no split pays). ``found``: columns x 2 x nodes x bins."""
    left = np.cumsum(found, axis=3)[..., :-1]
    total = found.sum(axis=3, keepdims=True)
    right = total - left

    def score(part: Array) -> Array:
        return _shrunk(part[:, 0], params.l1) ** 2 / np.maximum(part[:, 1] + params.l2, 1e-12)

    gain = (score(left) + score(right) - score(total)) / 2 - params.gamma
    gain = np.where((left[:, 1] >= params.min_child) & (right[:, 1] >= params.min_child) & (gain > 1e-12), gain, -np.inf)
    flat = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)       # nodes x (columns, bins)
    best = flat.argmax(axis=1)
    return best // gain.shape[2], best % gain.shape[2], flat[np.arange(len(flat)), best]


def _keep_best_first(gains: Array, leaves: int) -> Array:
    """Which splits of one tree stay if the leaf with the largest gain is split until there are ``leaves``."""
    keep, ready = np.zeros(len(gains), bool), {0}
    for _ in range(leaves - 1):
        ready = {n for n in ready if np.isfinite(gains[n])}
        if not ready:
            break
        n = max(ready, key=lambda i: (gains[i], -i))
        keep[n] = True
        ready = (ready - {n}) | {c for c in (2 * n + 1, 2 * n + 2) if c < len(gains)}
    return keep


def _leaf_sums(blocks: DataFrame, sampler: Sampler, segment: int, growing: dict[int, Grown], pending: list[list[Grown]]) -> dict[int, Array]:
    """Per fit and tree: for its leaves, rows shared with all leaves and residual sums, of its sample and of the validation rows.

    One more number per tree is the squared residual of the validation rows.
    """
    trees = sampler.params.segment

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Array] = {}
        for batch in batches:
            for block in Block.read(batch):
                _apply(block, pending)
                for fit, grown in growing.items():
                    leaves = grown.feature.shape[1] + 1
                    spot = grown.leaves(block.bins) + np.arange(trees) * leaves
                    z = np.zeros((len(block.y), trees * leaves), np.float32)       # counts of a block are exact in it
                    z[np.arange(len(z))[:, None], spot] = 1
                    val, r = block.roles[fit] == VAL, block.residual[fit]
                    drawn = z.reshape(len(z), trees, leaves) * sampler.rows(block, fit, segment).T[:, :, None]
                    drawn = drawn.reshape(z.shape)
                    both, both_val = drawn.T @ z, z[val].T @ z[val]
                    own, own_val = drawn.T.astype(float) @ r, z[val].T.astype(float) @ r[val]
                    square = float(r[val] @ r[val])
                    for t in range(trees):
                        mine = slice(t * leaves, (t + 1) * leaves)
                        found = np.concatenate([both[mine].ravel(), own[mine], both_val[mine].ravel(), own_val[mine], [square]]).astype(float)
                        slot = fit * trees + t
                        sums[slot] = sums[slot] + found if slot in sums else found
        yield from _emit(sums)

    return _summed(blocks.mapInArrow(work, "slot int, vector binary"))


def _values(sums: list[Array], params: BoostParams, leaves: int) -> tuple[Array, Array, Array]:
    """Leaf values of a segment, one tree after the other, their rows, and the squared validation loss after each tree."""
    trees = len(sums)
    size = leaves * trees * leaves
    values, cover, losses = np.zeros((trees, leaves)), np.zeros((trees, leaves)), np.zeros(trees)
    loss = sums[0][-1]
    for t, s in enumerate(sums):
        both = s[:size].reshape(leaves, trees, leaves)
        own = s[size:size + leaves]
        both_val = s[size + leaves:2 * size + leaves].reshape(leaves, trees, leaves)
        own_val = s[2 * size + leaves:2 * size + 2 * leaves]
        rows = both[:, t, :].diagonal()
        left = own - np.einsum("ltm,tm->l", both[:, :t], values[:t])        # what the trees before leave over
        v = params.step * _shrunk(left, params.l1) / np.maximum(rows + params.l2, 1e-12)
        v[rows == 0] = 0.0
        left_val = own_val - np.einsum("ltm,tm->l", both_val[:, :t], values[:t])
        loss += both_val[:, t, :].diagonal() @ (v * v) - 2 * v @ left_val
        values[t], cover[t], losses[t] = v, rows, loss
    return values, cover, losses


def _stored(blocks: DataFrame, pending: list[list[Grown]]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in Block.read(batch):
                _apply(block, pending)
                found.append(block.residual.tobytes())
            yield batch.set_column(batch.schema.get_field_index("residual"), "residual", pa.array(found, pa.binary()))

    return materialise(blocks.mapInArrow(work, BLOCKS), "boosting-blocks")


def best_iteration(losses: Sequence[float], patience: int) -> int:
    """Number of trees with the lowest loss, looking no further than ``patience`` trees past it."""
    best, at = float("inf"), 0
    for i, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return at


def fit_boosted(rows: DataFrame, y: str, features: Sequence[Sequence[str]], params: BoostParams = BOOST_A) -> list[BoostedModel]:
    """Fits over the same rows, one per list of columns; ``roles`` says of each row what it is to each fit.

    Every model ends at its best tree by the loss on its validation rows; ``losses`` holds the mean squared loss after every tree that was grown.
    A fit goes on until ``patience`` trees bring nothing better, or ``trees`` are grown. A fit without training rows has no trees.
    """
    cols = list(dict.fromkeys(c for fit in features for c in fit))
    rows = rows.where(complete([y, *cols])).select(y, *cols, "roles")
    borders = bin_borders(rows, cols, params.bins)
    width = max(len(b) for b in borders) + 1
    sides = rows.agg(*[F.avg(F.when(F.get("roles", F.lit(i)) == TRAIN, F.col(y))).alias(f"m{i}") for i in range(len(features))],
                     *[F.count(F.when(F.get("roles", F.lit(i)) == VAL, F.lit(1))).alias(f"v{i}") for i in range(len(features))]).first()
    base = np.array([float(sides[f"m{i}"] or 0.0) for i in range(len(features))])
    blocks = blocks_of(rows, y, cols, borders, base)
    sampler = Sampler(params, [[cols.index(c) for c in fit] for fit in features])
    trees, inner, leaves = params.segment, 2 ** params.depth - 1, 2 ** params.depth
    models = [BoostedModel(list(cols), float(b), np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)), np.zeros((0, leaves)))
              for b in base]
    active = [i for i in range(len(features)) if sides[f"m{i}"] is not None]
    pending: list[list[Grown]] = [[] for _ in features]
    segment = 0
    while active:
        growing = {i: Grown(np.zeros((trees, inner), np.int32), np.full((trees, inner), width, np.int32)) for i in active}
        gains = {i: np.full((trees, inner), -np.inf) for i in active}
        for level in range(params.depth):
            found = _histograms(blocks, sampler, segment, growing, level, pending, width)
            first, nodes = 2 ** level - 1, 2 ** level
            for i in active:
                chosen = sampler.cols(i, segment)
                for t in range(trees):
                    place, cut, gain = _best_splits(found[i * trees + t].reshape(len(chosen[t]), 2, nodes, width), params)
                    splits = np.isfinite(gain)
                    at = slice(first, first + nodes)
                    gains[i][t, at] = gain
                    growing[i].feature[t, at] = np.where(splits, chosen[t][place], 0)
                    growing[i].cut[t, at] = np.where(splits, cut, width)
        if params.leaves is not None and params.leaves < leaves:
            for i in active:
                for t in range(trees):
                    drop = ~_keep_best_first(gains[i][t], params.leaves)
                    growing[i].cut[t, drop], growing[i].feature[t, drop] = width, 0
        found = _leaf_sums(blocks, sampler, segment, growing, pending)
        for i in list(active):
            grown, model = growing[i], models[i]
            grown.value, cover, losses = _values([found[i * trees + t] for t in range(trees)], params, leaves)
            pending[i].append(grown)
            cuts = [np.r_[b, np.full(width + 1 - len(b), np.inf)] for b in borders]
            threshold = np.array([[cuts[f][c] for f, c in zip(fs, cs, strict=True)] for fs, cs in zip(grown.feature, grown.cut, strict=True)])
            models[i] = replace(
                model, feature=np.r_[model.feature, grown.feature], threshold=np.r_[model.threshold, threshold],
                value=np.r_[model.value, grown.value], cover=np.r_[model.cover, cover],
                losses=model.losses + (losses / max(1, sides[f"v{i}"])).tolist())
            grown_trees = len(models[i].losses)
            if grown_trees - best_iteration(models[i].losses, params.patience) >= params.patience or grown_trees >= params.trees:
                active.remove(i)
        segment += 1
        if segment % STORE_EVERY == 0 and active:
            blocks = _stored(blocks, pending)
            pending = [[] for _ in features]
    out = []
    for model, fit in zip(models, features, strict=True):
        best = model.first(best_iteration(model.losses, params.patience))
        number = np.array([list(fit).index(c) if c in fit else 0 for c in cols], np.int32)
        out.append(replace(best, features=list(fit), feature=number[best.feature] if best.feature.size else best.feature))
    return out


# -- scoring and attribution -------------------------------------------------------------------
def _with_column(df: DataFrame, cols: Sequence[str], name: str, kind: str, compute) -> DataFrame:
    """Add a column computed from a matrix of columns; rows that lack one get null."""
    inputs = F.when(complete(cols), F.array(*[F.col(c).cast("double") for c in cols]))
    schema = df.withColumn(name, F.lit(None).cast(kind)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_inputs")
            whole = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            found = compute(x.drop_null().flatten().to_numpy().reshape(-1, len(cols)))
            place = np.full(len(batch), -1)
            place[whole] = np.arange(len(whole))
            column = found.take(pa.array(place, mask=place < 0))
            rest = batch.drop_columns(["_inputs"])
            yield pa.record_batch([*rest.columns, column], names=[*rest.schema.names, name])

    return df.drop(name).withColumn("_inputs", inputs).mapInArrow(work, schema)


def score_boosted(df: DataFrame, model: BoostedModel, name: str = "predicted") -> DataFrame:
    """Add the prediction of a fitted ensemble, by arrays over batches of rows."""
    return _with_column(df, model.features, name, "double", lambda x: pa.array(model.predict(x), pa.float64()))


@dataclass
class LeafPaths:
    """For every leaf of an ensemble: its value and, per column on its path, the interval and the share of rows that pass."""

    value: Array        # leaves
    feature: Array      # leaves x depth, columns on the path, each once; -1 beyond
    low: Array          # a row passes where low < x <= high
    high: Array
    share: Array        # product of the shares of the splits on this column

    @classmethod
    def of(cls, model: BoostedModel) -> LeafPaths:
        depth, inner = model.depth, model.feature.shape[1]
        weight = [model.cover]
        for _ in range(depth):
            weight.insert(0, weight[0].reshape(len(model.cover), -1, 2).sum(axis=2))
        weight = np.concatenate(weight, axis=1)         # rows of every node
        rows = []
        for t in range(len(model.value)):
            for leaf in range(inner + 1):
                if weight[t, inner + leaf] == 0 and (model.threshold[t] == np.inf).any():
                    continue        # behind a node that does not split
                path: dict[int, list[float]] = {}
                node = 0
                for level in range(depth - 1, -1, -1):
                    right = leaf >> level & 1
                    child = 2 * node + 1 + right
                    cut = model.threshold[t, node]
                    if np.isfinite(cut):
                        entry = path.setdefault(int(model.feature[t, node]), [-np.inf, np.inf, 1.0])
                        entry[0 if right else 1] = max(entry[0], cut) if right else min(entry[1], cut)
                        entry[2] *= weight[t, child] / weight[t, node] if weight[t, node] else 0.0
                    node = child
                names = [*path, *[-1] * (depth - len(path))]
                filled = [*path.values(), *[[-np.inf, np.inf, 1.0]] * (depth - len(path))]
                rows.append((model.value[t, leaf], names, *zip(*filled, strict=True)))
        value, feature, low, high, share = zip(*rows, strict=True) if rows else ((), np.zeros((0, depth)), *(np.zeros((0, depth)),) * 3)
        return cls(np.array(value, float), np.array(feature, int), np.array(low, float), np.array(high, float), np.array(share, float))

    def attributions(self, x: Array, columns: int) -> Array:
        """Exact path-dependent Shapley values (rows x columns).

        On the path of a leaf only its own columns count, so the sum over coalitions is over subsets of at most depth columns; a
        column outside the coalition passes with its share.
        """
        out = np.zeros((len(x), columns))
        depth = self.feature.shape[1]
        for used in range(1, depth + 1):
            mine = np.flatnonzero((self.feature >= 0).sum(axis=1) == used)
            for at in range(0, len(mine), 1000):        # bounds memory
                leaves = mine[at:at + 1000]
                f = self.feature[leaves, :used]
                passes = (x[:, f] > self.low[leaves, :used]) & (x[:, f] <= self.high[leaves, :used])
                share = np.broadcast_to(self.share[leaves, :used], passes.shape)
                for i in range(used):
                    others = [j for j in range(used) if j != i]
                    total = np.zeros(passes.shape[:2])
                    for subset in range(1 << len(others)):
                        inside = [j for b, j in enumerate(others) if subset >> b & 1]
                        term = np.full(passes.shape[:2], _coalition_weight(len(inside), used))
                        for j in others:
                            term = term * (passes[:, :, j] if j in inside else share[:, :, j])
                        total += term
                    phi = total * (passes[:, :, i] - share[:, :, i]) * self.value[leaves]
                    for c in np.unique(f[:, i]):
                        out[:, c] += phi[:, f[:, i] == c].sum(axis=1)
        return out


def _coalition_weight(inside: int, players: int) -> float:
    """Share of the orders in which exactly ``inside`` of the others come before a player."""
    out = 1.0 / players
    for i in range(inside):
        out *= (i + 1) / (players - 1 - i)
    return out


def tree_attributions(df: DataFrame, model: BoostedModel, name: str = "attributions") -> DataFrame:
    """Add an array with the exact Shapley value of every column of the model, in the model's order; they sum to prediction - mean."""
    paths, n = LeafPaths.of(model), len(model.features)

    def compute(x: Array) -> pa.Array:
        parts = [paths.attributions(x[i:i + 512], n) for i in range(0, len(x), 512)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(flat))

    return _with_column(df, model.features, name, "array<double>", compute)


def expected_value(model: BoostedModel) -> float:
    """The mean prediction that attributions start from: leaf values weighted by the rows of their training sample."""
    rows = model.cover.sum(axis=1)
    return model.base + float(np.divide((model.cover * model.value).sum(axis=1), rows, out=np.zeros(len(rows)), where=rows > 0).sum())


def tree_attribution(df: DataFrame, model: BoostedModel, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute Shapley value per feature of a fitted ensemble."""
    found = tree_attributions(df.select(*by, *[c for c in model.features if c not in by]), model).where("attributions is not null")
    wide = found.groupBy(*by).agg(*[F.avg(F.abs(F.get("attributions", F.lit(i)))).alias(c) for i, c in enumerate(model.features)])
    return wide.unpivot([*by], model.features, "feature", "mean_abs_shap")


# -- node tables -------------------------------------------------------------------------------
NODES = "tree int, node int, feature string, threshold double, value double, cover double"


def node_table(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """The ensemble as rows (tree, node): inner nodes with column and threshold, leaves with value and rows; tree -1 holds the base."""
    inner = model.feature.shape[1]
    rows = [(-1, i, c, None, model.base if i == 0 else None, None) for i, c in enumerate(model.features)]
    for t in range(len(model.value)):
        rows += [(t, n, model.features[f], float(c), None, None)
                 for n, (f, c) in enumerate(zip(model.feature[t], model.threshold[t], strict=True))]
        rows += [(t, inner + n, None, None, float(v), float(w)) for n, (v, w) in enumerate(zip(model.value[t], model.cover[t], strict=True))]
    return spark.createDataFrame(rows, NODES)


def from_nodes(nodes: DataFrame) -> BoostedModel:
    """The ensemble of a node table (bounded by trees, not by rows)."""
    rows = sorted(nodes.collect(), key=lambda r: (r["tree"], r["node"]))
    head, body = [r for r in rows if r["tree"] < 0], [r for r in rows if r["tree"] >= 0]
    features = [r["feature"] for r in head]
    trees = 1 + max((r["tree"] for r in body), default=-1)
    per = len(body) // trees if trees else 7
    inner = per // 2
    split = [r for r in body if r["node"] < inner]
    leaf = [r for r in body if r["node"] >= inner]
    shape, wide = (trees, inner), (trees, per - inner)
    return BoostedModel(features, head[0]["value"], np.array([features.index(r["feature"]) for r in split], np.int32).reshape(shape),
                        np.array([r["threshold"] for r in split], float).reshape(shape),
                        np.array([r["value"] for r in leaf], float).reshape(wide), np.array([r["cover"] for r in leaf], float).reshape(wide))

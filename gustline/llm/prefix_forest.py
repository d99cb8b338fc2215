"""Approximate nearest neighbours by inner product with a forest of hash prefixes.

Every tree gives each vector a long hash string: one bit per random hyperplane. A tree is the array of its strings in sorted order,
cut into chunks of bounded size; vectors that share a prefix stand side by side. A query descends in every tree to its
longest prefix match and then ascends in all trees at once: the prefix is shortened by one bit everywhere until the vectors under it, over all
trees, are at least ``wanted``. These vectors, all of them, are compared with the query by their whole inner product.

1. Equal vectors are one class, with as many of its smallest ids as an answer can need, so a vector with very many copies costs one place.
2. Vectors are scaled into the unit ball and lifted onto the sphere, queries are scaled to length one; then the largest inner product is
   the smallest angle, which the bits follow.
3. ``wanted`` is fitted: for at most ``FIT_QUERIES`` queries the true neighbours come from one pass over all classes, and the
   smallest number is taken whose ascents reach ``RECALL`` of them. The fit holds for tables of every size; every vector is indexed.
4. Ascent: the size of a prefix is the difference of two places in the sorted array. A query asks the chunks in which its
   prefixes begin and end, and the answers are added up.
5. Gathering: each query goes to the chunks that its prefix overlaps; there, queries times vectors is a blocked product, and only the best of a
   chunk leave it.

Chunks are ranges of keys; the last ``TAIL_BITS`` bits of a key are arbitrary and split stretches of equal strings, so no task gets an unbounded
group. Borders are approximate quantiles of all keys.

Defined results: rows with a null, empty or zero vector, or one with null or non-finite components, and rows without ``vec_id`` take no part;
shorter vectors count as filled up with zeros; equal rows count once; rows that share a ``vec_id`` are one thing with several vectors, of
which the largest product counts, and are no candidates for themselves; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.operators.blocks import salted_lookup
from gustline.session import materialise

TOP = 20
EVERY = 20
TREES = 8
HASH_BITS, TAIL_BITS = 46, 16       # of a key, a long that is never negative
END = 1 << (HASH_BITS + TAIL_BITS)
CHUNK_ROWS = 20_000
FIT_QUERIES = 256
RECALL = 0.97
SEED = 20_240_607
BLOCK, QUERY_BLOCK = 4096, 128
Array = np.ndarray


def usable(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """Distinct (id, v, digest) rows that take part; components stay as they are, floats or doubles."""
    single = vectors.schema[vector_name].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    rows = vectors.select(F.col(id_name).cast("long").alias("id"), F.col(vector_name).cast(f"array<{kind}>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    # a zero at the end says nothing, and -0.0 is 0.0
    last = F.array_max(F.transform("v", lambda x, i: F.when(x != 0, i + 1)))
    rows = rows.withColumn("v", F.transform(F.slice("v", 1, last), lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)))
    return rows.withColumn("digest", F.md5(F.col("v").cast("string").cast("binary")))


def classes_of(rows: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Stored classes (cls, digest, asks, ids, v) and the queries (id, digest).

    ``ids`` are the k + 1 smallest of the class: a query needs no more, as all of them are equally near.
    """
    ids = rows.select("digest", "id").distinct()
    first = ids.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("place") <= k + 1)
    first = first.groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("ids"))     # at most k + 1
    one = rows.groupBy("digest").agg(F.first("v").alias("v"), F.max(is_query).alias("asks"))
    stored = materialise(one.join(first, "digest").select(
        F.monotonically_increasing_id().alias("cls"), "digest", "asks", "ids", "v"), "vector-classes")
    return stored, ids.where(is_query)


@dataclass
class Forest:
    """The hash functions: hyperplanes of all trees over vectors lifted by one dimension."""

    dims: int
    longest: float
    trees: int

    def _planes(self) -> Array:
        return np.random.default_rng(SEED).standard_normal((self.dims + 1, self.trees * HASH_BITS))

    def matrix(self, lists: pa.Array) -> Array:
        """Vectors of a column as rows, filled up with zeros."""
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(sizes), self.dims))
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        return out

    def strings(self, x: Array, query: bool) -> Array:
        """Hash strings (rows x trees) as the high bits of keys."""
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        if query:
            lifted = np.c_[x / length[:, None], np.zeros(len(x))]
        else:
            lifted = np.c_[x / self.longest, np.sqrt(np.maximum(0.0, 1 - (length / self.longest) ** 2))]
        bits = (lifted @ self._planes() > 0).reshape(len(x), self.trees, HASH_BITS)
        return (bits @ (1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64))) << TAIL_BITS

    def keys(self, x: Array, cls: Array) -> Array:
        """Keys of points: the string, and bits of the class that only split equal strings."""
        mixed = (cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TAIL_BITS)
        return self.strings(x, query=False) | mixed.astype(np.int64)[:, None]


def prefix_range(string: Array, level: int | Array) -> tuple[Array, Array]:
    """First key under the prefix of ``level`` bits, and the first one behind it."""
    free = HASH_BITS + TAIL_BITS - level
    lo = (string >> free) << free
    return lo, lo + (np.int64(1) << free)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            yield batch.slice(at, BLOCK)


def tree_keys(classes: DataFrame, forest: Forest) -> DataFrame:
    """(tree, key) of all classes in all trees."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            keys = forest.keys(forest.matrix(part.column("v")), part.column("cls").to_numpy())
            yield pa.record_batch({"tree": pa.array(np.tile(np.arange(forest.trees), len(part)), pa.int32()),
                                   "key": pa.array(keys.ravel())})

    return classes.select("cls", "v").mapInArrow(work, "tree int, key long")


@dataclass
class Chunks:
    """Chunks of the sorted arrays: the keys that begin the second and later chunks of every tree, and their offsets.

    One number per ``CHUNK_ROWS`` rows of an array.
    """

    borders: list[Array]
    offsets: list[Array]        # places before each chunk, and all places

    def of(self, tree: int, key: Array) -> Array:
        return np.searchsorted(self.borders[tree], key, side="right")

    def known(self, tree: int, key: Array) -> tuple[Array, Array]:
        """Whether a key is a border, so that no chunk need be asked, and the number of places before it."""
        edges = np.r_[0, self.borders[tree], END]
        at = np.searchsorted(edges, key)
        return edges[at] == key, self.offsets[tree][at]


def chunk_borders(classes: DataFrame, forest: Forest, n: int, chunk_rows: int) -> Chunks:
    """Borders at approximate quantiles of the keys and at all short prefixes, and how many keys lie before each chunk.

    Short prefixes, which many queries share, so begin and end at borders and are not asked for.
    """
    parts = max(1, -(-n // chunk_rows))
    depth = (parts - 1).bit_length()
    short = np.arange(1, 1 << depth, dtype=np.int64) << (HASH_BITS + TAIL_BITS - depth)
    borders = [short] * forest.trees
    if parts > 1:
        cuts = [i / parts for i in range(1, parts)]
        found = tree_keys(classes, forest).groupBy("tree").agg(F.percentile_approx("key", cuts, max(10_000, 20 * parts)).alias("cuts"))
        for row in found.collect():     # one row per tree
            borders[row["tree"]] = np.unique(np.r_[short, np.array(row["cuts"], np.int64)])
    chunks = Chunks(borders, [])
    counts = tree_keys_dealt(classes, forest, chunks).groupBy("tree", "part").agg(F.count("*").alias("n"))
    sizes = [np.zeros(len(b) + 2, np.int64) for b in borders]
    for row in counts.collect():        # one row per chunk
        sizes[row["tree"]][row["part"] + 1] = row["n"]
    chunks.offsets = [np.cumsum(x) for x in sizes]
    return chunks


def _dealt(forest: Forest, chunks: Chunks, keys: Array) -> tuple[Array, Array]:
    tree = np.tile(np.arange(forest.trees), len(keys))
    part = np.stack([chunks.of(t, keys[:, t]) for t in range(forest.trees)], axis=1).ravel()
    return tree, part


def tree_keys_dealt(classes: DataFrame, forest: Forest, chunks: Chunks) -> DataFrame:
    """(tree, part, key): the sorted arrays' keys with their chunk."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            keys = forest.keys(forest.matrix(block.column("v")), block.column("cls").to_numpy())
            tree, part = _dealt(forest, chunks, keys)
            yield pa.record_batch({"tree": pa.array(tree, pa.int32()), "part": pa.array(part, pa.int32()), "key": pa.array(keys.ravel())})

    return classes.select("cls", "v").mapInArrow(work, "tree int, part int, key long")


def _levels(string: int) -> tuple[Array, Array]:
    """Ranges of the prefixes of all lengths, 0 first."""
    return prefix_range(np.full(HASH_BITS + 1, string, np.int64), np.arange(HASH_BITS + 1))


def prefix_sizes(classes: DataFrame, forest: Forest, chunks: Chunks) -> DataFrame:
    """(cls, sizes): how many places of all trees lie under each prefix of a query class, from length 0 on."""
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            strings = forest.strings(forest.matrix(block.column("v")), query=True)
            out = []
            for cls, row in zip(block.column("cls").to_pylist(), strings.tolist(), strict=True):
                for t, string in enumerate(row):
                    ends = np.concatenate(_levels(string))
                    open_ends = ends[~chunks.known(t, ends)[0]]
                    home = int(chunks.of(t, string))
                    out += [(t, p, cls, string, p == home) for p in {home, *chunks.of(t, open_ends).tolist()}]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                                  names=["tree", "part", "cls", "string", "home"])

    def counted(keys: pa.Table, queries: pa.Table) -> pa.Table:
        sizes = np.zeros((queries.num_rows, HASH_BITS + 1), np.int64)
        if queries.num_rows:
            tree, part = queries.column("tree")[0].as_py(), queries.column("part")[0].as_py()
            ordered, offset = np.sort(keys.column("key").to_numpy()), chunks.offsets[tree][part]
            string, home = queries.column("string").to_numpy(), queries.column("home").to_numpy()
            for level in range(HASH_BITS + 1):
                for end, sign in zip(prefix_range(string, level), (-1, 1), strict=True):
                    known, before = chunks.known(tree, end)
                    here = ~known & (chunks.of(tree, end) == part)
                    sizes[:, level] += sign * (np.where(here, offset + np.searchsorted(ordered, end), 0) + np.where(known & home, before, 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(queries.num_rows + 1) * (HASH_BITS + 1), pa.int32()), pa.array(sizes.ravel()))
        return pa.table({"cls": queries.column("cls"), "sizes": lists})

    asks = classes.where("asks").select("cls", "v").mapInArrow(asked, "tree int, part int, cls long, string long, home boolean")
    places = tree_keys_dealt(classes, forest, chunks)
    answers = places.groupBy("tree", "part").cogroup(asks.groupBy("tree", "part")).applyInArrow(counted, "cls long, sizes array<long>")
    levels = [F.sum(F.get("sizes", F.lit(i))).alias(f"s{i}") for i in range(HASH_BITS + 1)]
    return answers.groupBy("cls").agg(*levels).select("cls", F.array(*[f"s{i}" for i in range(HASH_BITS + 1)]).alias("sizes"))


def _products(points: Array, queries: Array, cls: Array, first: Array, k: int) -> Iterator[tuple[Array, Array, Array]]:
    """For each query the best ``k`` points as (query row, class, product), ties to the smaller first id.

    A blocked product chooses; the numbers given out are sums over the components of one row, the same wherever it stands.
    """
    for at in range(0, len(queries), QUERY_BLOCK):
        some = queries[at:at + QUERY_BLOCK]
        product = some @ points.T
        width = len(points)
        if width > k:
            edge = np.partition(product, width - k, axis=1)[:, width - k]
            row, point = np.nonzero(product >= (edge - 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None])
        else:
            row, point = (x.ravel() for x in np.indices(product.shape))
        exact = (points[point] * some[row]).sum(axis=1)
        by = np.lexsort((first[point], -exact, row))
        row, point, exact = row[by], point[by], exact[by]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield at + row[best], cls[point[best]], exact[best]


def _found(parts: list[tuple[Array, Array, Array]], names: Array) -> pa.Table:
    q, c, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"query": pa.array(names[q.astype(np.int64)] if len(q) else q, pa.int64()), "cls": pa.array(c, pa.int64()),
                     "score": pa.array(s, pa.float64())})


FOUND = "query long, cls long, score double"


def gathered(classes: DataFrame, levels: DataFrame, forest: Forest, chunks: Chunks, k: int) -> DataFrame:
    """(query class, class, score): the best of each chunk under the prefixes that ``levels`` (cls, level) names."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            keys = forest.keys(forest.matrix(block.column("v")), block.column("cls").to_numpy())
            tree, part = _dealt(forest, chunks, keys)
            row = pa.array(np.repeat(np.arange(len(block)), forest.trees))
            yield pa.record_batch({
                "tree": pa.array(tree, pa.int32()), "part": pa.array(part, pa.int32()), "key": pa.array(keys.ravel()),
                "cls": block.column("cls").take(row), "first": block.column("first").take(row), "v": block.column("v").take(row)})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            strings = forest.strings(forest.matrix(block.column("v")), query=True)
            out = []
            for row, (mine, level) in enumerate(zip(strings, block.column("level").to_pylist(), strict=True)):
                lo, hi = prefix_range(mine, level)
                for t in range(forest.trees):
                    a, z = chunks.of(t, lo[t]), chunks.of(t, hi[t] - 1)
                    out += [(row, t, p, lo[t], hi[t]) for p in range(a, z + 1)]
            rows, tree, part, lo, hi = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
            yield pa.record_batch({"tree": pa.array(tree, pa.int32()), "part": pa.array(part, pa.int32()), "lo": pa.array(lo), "hi": pa.array(hi),
                                   "query": block.column("cls").take(pa.array(rows)), "q": block.column("v").take(pa.array(rows))})

    def compared(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not points.num_rows or not queries.num_rows:
            return _found([], np.zeros(0, np.int64))
        points = points.sort_by("key")
        key, cls, first = (points.column(c).to_numpy() for c in ("key", "cls", "first"))
        x = forest.matrix(points.column("v").combine_chunks())
        q, names = forest.matrix(queries.column("q").combine_chunks()), queries.column("query").to_numpy()
        i = np.searchsorted(key, queries.column("lo").to_numpy())
        j = np.searchsorted(key, queries.column("hi").to_numpy())
        spans, which = np.unique(np.stack([i, j], axis=1), axis=0, return_inverse=True)
        parts = []
        for s, (a, z) in enumerate(spans.tolist()):
            mine = np.flatnonzero(which.ravel() == s)
            if a < z:
                parts += [(mine[r], c, v) for r, c, v in _products(x[a:z], q[mine], cls[a:z], first[a:z], k)]
        return _found(parts, names)

    kind = classes.schema["v"].dataType.simpleString()
    places = classes.select("cls", F.get("ids", F.lit(0)).alias("first"), "v").mapInArrow(
        placed, f"tree int, part int, key long, cls long, first long, v {kind}")
    asks = classes.join(levels, "cls").select("cls", "level", "v").mapInArrow(
        sent, f"tree int, part int, lo long, hi long, query long, q {kind}")
    return places.groupBy("tree", "part").cogroup(asks.groupBy("tree", "part")).applyInArrow(compared, FOUND)


def true_neighbours(classes: DataFrame, sample: list, forest: Forest, k: int) -> DataFrame:
    """(query, cls, score) by brute force for a bounded sample of queries, in one pass over all classes."""
    names = np.array([r["cls"] for r in sample], np.int64)
    q = forest.matrix(pa.array([r["v"] for r in sample], pa.list_(pa.float64())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x, cls = forest.matrix(block.column("v")), block.column("cls").to_numpy()
            parts = list(_products(x, q, cls, block.column("first").to_numpy(), k))
            yield from _found(parts, names).to_batches()

    rows = classes.select("cls", F.get("ids", F.lit(0)).alias("first"), "v").mapInArrow(work, FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    return rows.where(F.col("query") != F.col("cls")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def fitted_size(classes: DataFrame, sizes: DataFrame, forest: Forest, k: int, recall: float) -> int:
    """How many places an ascent must reach so that the sampled queries find ``recall`` of their true neighbours."""
    least = (k + 1) * forest.trees      # so many places always hold k other classes, if there are as many
    asking = classes.where("asks").orderBy(F.xxhash64("digest"), "digest").limit(FIT_QUERIES)
    sample = asking.select("cls", "v").collect()
    near = true_neighbours(classes, sample, forest, k).join(classes.select("cls", "v"), "cls").select("query", "v").collect()
    if not near:
        return least
    reached = {r["cls"]: np.array(r["sizes"]) for r in sizes.join(F.broadcast(asking.select("cls")), "cls").collect()}
    kind = pa.list_(pa.float64())
    mine = dict(zip((r["cls"] for r in sample), forest.strings(forest.matrix(pa.array([r["v"] for r in sample], kind)), query=True), strict=True))
    theirs = forest.strings(forest.matrix(pa.array([r["v"] for r in near], kind)), query=False)
    # the longest prefix shared in any tree, and the places an ascent to one bit more holds: it goes on if they are fewer than wanted
    needed = []
    for r, other in zip(near, theirs, strict=True):
        apart = np.bitwise_xor(mine[r["query"]], other) >> TAIL_BITS
        shared = max(HASH_BITS - int(a).bit_length() for a in apart.tolist())
        needed.append(reached[r["query"]][shared + 1] + 1 if shared < HASH_BITS else 0)
    needed.sort()
    return max(least, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]))


def nearest(vectors: DataFrame, is_query: Column, k: int = TOP, trees: int = TREES, recall: float = RECALL, wanted: int | None = None,
            id_name: str = "vec_id", vector_name: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row that ``is_query`` (a condition on ``id``) picks."""
    classes, queries = classes_of(usable(vectors, id_name, vector_name), is_query, k)
    about = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(
        F.sqrt(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("longest")).first()
    forest = Forest(about["dims"] or 1, about["longest"] or 1.0, trees)
    chunks = chunk_borders(classes, forest, about["n"], chunk_rows)
    sizes = materialise(prefix_sizes(classes, forest, chunks), "prefix-sizes")
    wanted = wanted if wanted is not None else fitted_size(classes, sizes, forest, k, recall)
    enough = F.filter(F.transform("sizes", lambda s, i: F.when(s >= wanted, i)), lambda i: i.isNotNull())
    levels = sizes.select("cls", F.coalesce(F.array_max(enough), F.lit(0)).alias("level"))

    found = gathered(classes, levels, forest, chunks, k + 1).groupBy("query", "cls").agg(F.max("score").alias("score"))
    named = materialise(found, "found").join(classes.select("cls", "ids"), "cls")
    top = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    near = (named.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1)
            .select("query", "score", F.explode("ids").alias("vec_id")))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    near = near.where(F.col("place") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    answers = near.join(classes.select(F.col("cls").alias("query"), "digest"), "query").select("digest", "near")
    # one class may hold a third of the queries
    rows = salted_lookup(queries.select(F.col("id").alias("query_id"), "digest"), answers, ["digest"])
    rows = rows.select("query_id", F.inline("near")).where(F.col("vec_id") != F.col("query_id"))
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """The contract's queries: every vector whose id is divisible by 20."""
    return nearest(vectors, F.col("id") % EVERY == 0)

"""Jaccard join of word-shingle sets, light and heavy sets apart, and its classes of linked documents.

Two sets of sizes a <= b link if their overlap reaches c(a, b), the smallest overlap with the wanted similarity.

*Light sets* (few shingles) enumerate their subsets of c(a, b) elements for every partner size. Sets with an
equal subset link, without any comparison, so a group of them is joined through its first member only.

*Heavy sets* have too many subsets. Linked ones differ in at most k(a, b) elements, so when a hash deals the shingles
into more than k parts, a part that is not empty stays equal. The inverted lists are over such
parts. Lists over single shingles would hold every document with a common passage, while a part ties
together near copies only. Sets on a list are compared with its most central member first; what then links is one
class. Only members that lie outside the largest class of their list are compared with the
others on it, once for all lists of the same members, behind filters that never lose a link (parities of the shingles in 256 cells, then in as many cells as a set has
shingles, differ in at most as many cells as the sets differ in shingles). A near-copy group of any size so costs about one comparison a member.

A size is light where its subsets cost less than its parts, each of which may need a comparison
(``boundary``). A heavy set with fewer filled parts than needed also lists its smallest shingles, one more than a
linked partner can lack.

Defined results: null and empty texts have no shingles and link with nothing; texts of fewer words than a shingle
are one shingle; rows that share a ``doc_id`` are one document (one row each, one component); rows without ``doc_id`` get
their own numbers but take no part in links and have no component; repeated rows come out as often as
they went in; an empty table gives an empty result; other columns are not looked at. Sets are compared as sets of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import BROADCAST_ROWS, text_key
from gustline.llm.graph import components
from gustline.session import materialise

SKETCHES = ("doc_id long, text_key long, n int, d1 long, d2 long, s1 long, s2 long, s3 long, s4 long, parity binary, "
            "bucket int, once binary, more binary")
REMEMBERED = 300_000    # word hashes a task keeps; it starts anew beyond
PACKED_KEYS = 1_000_000     # keys a task packs at a time
BUCKET_DOCS = 2_000         # a bucket of packed keys holds about those of so many documents
SUFFIX = 40                 # bits of a key that are counted beside its bucket; more that meet only cost work
FILTER_BITS = 28            # the filter of keys met again has at most 2^28 bits, whatever the number of documents
C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9,
                            0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C[3]
    x = (x ^ (x >> np.uint64(27))) * C[4]
    return x ^ (x >> np.uint64(31))


def _tag(number: int, kind: int) -> np.uint64:
    return mixed(np.array([number * 8 + kind], np.uint64))[0]


@dataclass(frozen=True)
class Plan:
    """Sizes, overlaps and parts for a similarity of at least num / den."""

    num: int
    den: int
    shingle: int
    check_cost: int = 4

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def most(self, a: int) -> int:
        """Largest partner of a set of ``a``."""
        return a * self.den // self.num

    def least(self, b: int) -> int:
        """Smallest partner of a set of ``b``."""
        return -(-b * self.num // self.den)

    def apart(self, a: int, b: int) -> int:
        return (self.den - self.num) * (a + b) // (self.num + self.den)

    @lru_cache(maxsize=None)    # noqa: B019  a handful of plans live as long as the process
    def size_class(self, a: int) -> tuple[int, int]:
        """First and last size of the class of ``a``; classes grow by a quarter."""
        low = 1
        while True:
            high = max(low, low * 5 // 4)
            if a <= high:
                return low, high
            low = high + 1

    def needed(self, high: int) -> int:
        """Parts that must be filled: one more than linked sets can differ in."""
        return self.apart(high, self.most(high)) + 1

    def parts(self, high: int) -> int:
        need = self.needed(high)
        return need + 1 + need * (self.den - self.num) // (2 * self.num)

    @lru_cache(maxsize=None)    # noqa: B019
    def classes(self, n: int) -> tuple[tuple[int, int], ...]:
        """(last size, parts) of the classes that hold a smaller partner of ``n``, itself included."""
        found, a = [], self.least(n)
        while a <= n:
            high = self.size_class(a)[1]
            if self.needed(high) > 1:
                found.append((high, self.parts(high)))
            a = high + 1
        return tuple(found)

    @lru_cache(maxsize=None)    # noqa: B019
    def roles(self, n: int) -> tuple[tuple[int, int, int], ...]:
        """(a, b, overlap) for the partner sizes of ``n``, but for equal sets."""
        pairs = [(a, n) for a in range(self.least(n), n)] + [(n, b) for b in range(n, self.most(n) + 1)]
        return tuple((a, b, self.overlap(a, b)) for a, b in pairs if self.overlap(a, b) < b)

    def light_cost(self, n: int) -> int:
        return sum(comb(n, c) for _, _, c in self.roles(n))

    def heavy_cost(self, n: int) -> int:
        return self.check_cost * sum(parts for _, parts in self.classes(n))

    @cached_property
    def boundary(self) -> int:
        """Sets below are light."""
        n = 1
        while self.light_cost(n) <= max(1, self.heavy_cost(n)):
            n += 1
        return n


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()        # of bytes: A-Z only, and the six ASCII spaces
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.size + 1
        total = np.zeros(n, np.uint64)
        for i in range(self.size):
            total = mixed(total * C[0] + h[i:i + n] + C[1])
        return np.unique(total)


def signatures(x: np.ndarray, plan: Plan) -> np.ndarray:
    """Keys that a linked set shares.

    The lowest bit tells light keys, which need no comparison, from heavy ones; the next is set in light keys for
    unequal sizes, where an equal subset links a smaller set with the larger ones, but not two larger ones.
    """
    n, out = len(x), []
    m = mixed(x ^ C[2])
    heavy = ~np.uint64(3)
    if n and n < plan.boundary:
        total = m.sum(dtype=np.uint64)
        for a, b, c in plan.roles(n):
            tag = _tag(a * 1_000_003 + b, 0)
            gone = np.array([m[list(some)].sum(dtype=np.uint64) if some else 0 for some in combinations(range(n), n - c)],
                            np.uint64)
            out.append(mixed(total - gone + tag) & heavy | np.uint64(1 if a == b else 3))
    if n >= plan.least(plan.boundary):
        for high, parts in plan.classes(n):
            part = ((x >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ids, first = np.unique(part[order], return_index=True)
            sums = np.add.reduceat(m[order], first)
            tag = _tag(high, 1)
            out.append(mixed(sums + tag + ids.astype(np.uint64) * C[2]) & heavy)
            if len(ids) < plan.needed(high):
                few = np.sort(m)[:n - plan.overlap(plan.least(n), n) + 1]
                out.append(mixed(few + _tag(high, 2)) & heavy)
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _parities(x: np.ndarray, cells: int) -> np.ndarray:
    """Parity of the number of shingles in each of ``cells`` (a power of two), as bits."""
    odd = np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8))


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


class PackedKeys:
    """Keys of many documents by bucket (their first bits), five bytes each, so that equal ones can be found.

    Keys that a task meets twice are packed once, apart: a key of very many documents is as many entries as there are packs.
    """

    def __init__(self, bucket_bits: int) -> None:
        self.bits, self.waiting, self.held = bucket_bits, [], 0

    def short(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) >> np.uint64(64 - SUFFIX - self.bits)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(self.short(keys))
        self.held += len(keys)

    def flush(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.held = [], 0
        buckets = np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(SUFFIX)
        packs = []
        for some in (keys[counts == 1], keys[counts > 1]):
            raw = some.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SUFFIX // 8]
            cuts = np.searchsorted(some, buckets)
            packs.append([raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)])
        filled = [b for b, (once, more) in enumerate(zip(*packs, strict=True)) if once or more]
        names = [f.split()[0] for f in SKETCHES.split(", ")]
        kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 6 + [pa.binary()]
        return pa.record_batch([*[pa.nulls(len(filled), kind) for kind in kinds], pa.array(filled, pa.int32()),
                                *[pa.array([pack[b] for b in filled], pa.binary()) for pack in packs]], names=names)


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SUFFIX // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :SUFFIX // 8] = raw
    return out.view("<u8").ravel()


def _met(table: pa.Table) -> pa.Table:
    """The keys of a bucket that stand in several places."""
    keys, counts = np.unique(_unpacked(table.column("once")), return_counts=True)
    met = np.union1d(keys[counts > 1], _unpacked(table.column("more")))
    bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(SUFFIX)
    return pa.table({"met": pa.array((met | bucket).view(np.int64))})


@dataclass(frozen=True)
class KeyFilter:
    """Bits that say which keys may have been met again; its size is bounded, it never denies one that was."""

    bucket_bits: int
    bits: int
    words: np.ndarray

    @staticmethod
    def places(short: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(short ^ C[4])
        return h >> np.uint64(64 - bits), mixed(h + C[0]) >> np.uint64(64 - bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys.view(np.uint64) >> np.uint64(64 - SUFFIX - self.bucket_bits), self.bits):
            out &= (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


CHUNK_BITS = 20


def key_filter(met: DataFrame, rows: int, bucket_bits: int) -> KeyFilter:
    """The filter of a stored table of met keys, put together from chunks of its bits."""
    bits = min(FILTER_BITS, max(CHUNK_BITS, (16 * max(rows, 1)).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(KeyFilter.places(batch.column("met").to_numpy().view(np.uint64), bits))
            yield pa.record_batch({"chunk": pa.array((at >> np.uint64(CHUNK_BITS)).astype(np.int32)),
                                   "at": pa.array((at & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int32))})

    def chunk(table: pa.Table) -> pa.Table:
        filled = np.zeros(1 << CHUNK_BITS, np.uint8)
        filled[table.column("at").to_numpy()] = 1
        return pa.table({"chunk": table.column("chunk")[:1], "words": pa.array([np.packbits(filled, bitorder="little").tobytes()], pa.binary())})

    placed = met.mapInArrow(spots, "chunk int, at int").distinct()
    parts = placed.groupBy("chunk").applyInArrow(chunk, "chunk int, words binary").collect()     # 2^bits bits in all, at most
    size = 1 << (CHUNK_BITS - 3)
    words = np.zeros(1 << (bits - 3), np.uint8)
    for part in parts:
        words[part["chunk"] * size:(part["chunk"] + 1) * size] = np.frombuffer(part["words"], np.uint8)
    return KeyFilter(bucket_bits, bits, words)


def _digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _sketch_rows(plan: Plan, bucket_bits: int):
    """One sketch for each text, and between them packs of the keys of all texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, packed = Shingles(plan.shingle), PackedKeys(bucket_bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sizes, digests, small, sized = [], [], [], []
                for doc, text in zip(some.column("doc_id"), some.column("text"), strict=True):
                    x = shingles(_bytes(text))
                    sizes.append(len(x))
                    digests.append(_digest(x))
                    small.append(_parities(x, 256).view(np.int64))
                    sized.append(_parities(x, _cells(len(x))).tobytes())
                    if doc.is_valid and len(x):
                        packed.add(signatures(x, plan))
                digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                parity = np.stack(small)
                columns = [some.column("doc_id"), some.column("text_key"), pa.array(sizes, pa.int32()),
                           *[pa.array(np.ascontiguousarray(digest[:, k])) for k in range(2)],
                           *[pa.array(np.ascontiguousarray(parity[:, k])) for k in range(4)], pa.array(sized, pa.binary()),
                           pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary())]
                yield pa.record_batch(columns, names=[f.split()[0] for f in SKETCHES.split(", ")])
                if packed.held >= PACKED_KEYS:
                    yield packed.flush()
        last = packed.flush()
        if last is not None:
            yield last

    return rows


def _cells(n: int) -> int:
    """Cells of the parities of a set of ``n``: as many as shingles, so that sets which do not link differ in most."""
    return max(256, 1 << (n - 1).bit_length() if n else 0)


def _lists_of(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))


def _key_rows(plan: Plan, wanted):
    """(key, d1, d2) of the keys that may have been met again."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known = Shingles(plan.shingle), wanted.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, digests = [], []
                for text in batch.slice(at, 500).column("text"):
                    x = shingles(_bytes(text))
                    mine = signatures(x, plan)
                    mine = mine[known.holds(mine)] if len(mine) else mine
                    keys.append(mine)
                    digests.append(_digest(x))
                sizes = [len(k) for k in keys]
                digest = np.repeat(np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), sizes, axis=0)
                yield pa.record_batch([pa.array(np.concatenate(keys)), *[pa.array(np.ascontiguousarray(digest[:, k])) for k in range(2)]],
                                      names=["key", "d1", "d2"])

    return rows


def _set_rows(plan: Plan):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(plan.shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [shingles(_bytes(text)).view(np.int64) for text in some.column("text")]
                yield pa.record_batch([some.column("v"), _lists_of(sets)], names=["v", "x"])

    return rows


def _may_link(plan: Plan):
    """Keep pairs whose sets may link by their parities, folded to as many cells as the smaller side has. Never drops a link."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, n, m in zip(*[batch.column(c) for c in ("pu", "pv")], batch.column("nu").to_pylist(), batch.column("nv").to_pylist(),
                                  strict=True):
                a, b = (np.frombuffer(p.as_buffer(), np.uint8) for p in (a, b))
                while len(a) != len(b):     # cells are low bits of a shingle, so cell c of the half is c and c + half
                    a, b = (x[:len(x) // 2] ^ x[len(x) // 2:] if len(x) > min(len(a), len(b)) else x for x in (a, b))
                apart = int(np.bitwise_count(a ^ b).sum())
                keep.append(apart * (plan.num + plan.den) <= (plan.den - plan.num) * (n + m))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return rows


def _linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) of sets that link: by parities as large as the sets first, then by their whole sets."""
    facts = classes.select("v", "n", "parity")
    seen = pairs.join(facts.withColumnsRenamed({"v": "u", "n": "nu", "parity": "pu"}), "u").join(
        facts.withColumnsRenamed({"n": "nv", "parity": "pv"}), "v")
    pairs = materialise(seen.select("u", "v", "nu", "nv", "pu", "pv").mapInArrow(_may_link(plan), "u long, v long"), "may-link")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    wanted = materialise(wanted.join(classes.select("v", "first"), "v").select(
        "v", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")), "wanted")
    rows = wanted.count()
    wanted = F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    texts = texts.join(wanted, (F.col("doc_id") == F.col("first_id")) & (F.col("text_key") == F.col("first_key")))
    # rows that repeat an id with its text are one set
    sets = materialise(texts.select("v", "text").mapInArrow(_set_rows(plan), "v long, x array<long>"), "sets").dropDuplicates(["v"])
    both = (pairs.join(sets.withColumnsRenamed({"v": "u", "x": "xu"}), "u").join(sets, "v"))
    shared = F.size(F.array_intersect("xu", "x"))
    return both.where(shared * plan.den >= plan.num * (F.size("xu") + F.size("x") - shared)).select("u", "v").distinct()


def _filter(plan: Plan):
    """Can the sets on both sides link, by sizes and parities? Never false for a link."""
    apart = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(1, 5)), F.lit(0))
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return (small * plan.den >= large * plan.num) & (
        apart * (plan.num + plan.den) <= (plan.den - plan.num) * (small + large))


def _words() -> Column:
    """``parity`` as numbers of 64 bits, which Spark can compare."""
    return F.expr("transform(sequence(0, length(parity) div 8 - 1), "
                  "i -> cast(conv(hex(substring(parity, i * 8 + 1, 8)), 16, -10) as bigint))")


def _close(plan: Plan) -> Column:
    """``_filter``, then the parities in as many cells as the sets have shingles, the larger side folded once. Never false for a link."""
    a, b = F.col("a.words"), F.col("b.words")

    def odd(x, y):
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def folded(x):
        half = F.expr(f"size({x}) div 2")
        return odd(F.slice(F.col(x), F.lit(1), half), F.slice(F.col(x), half + 1, half))

    def near(differ):
        apart = F.aggregate(differ, F.lit(0), lambda total, x: total + F.bit_count(x))
        return apart * (plan.num + plan.den) <= (plan.den - plan.num) * (F.col("a.n") + F.col("b.n"))

    same, a_larger = F.size(a) == F.size(b), F.size(a) == F.size(b) * 2
    b_larger = F.size(b) == F.size(a) * 2
    return _filter(plan) & F.when(same, near(odd(a, b))).when(a_larger, near(odd(folded("a.words"), b))).when(
        b_larger, near(odd(a, folded("b.words")))).otherwise(F.lit(True))


def linked_documents(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for every row of ``docs``."""
    plan = Plan(num, den, shingle)
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    bucket_bits = min(20, max(1, docs.count() // BUCKET_DOCS).bit_length())
    stored = materialise(keyed.mapInArrow(_sketch_rows(plan, bucket_bits), SKETCHES), "sketches")
    sets = stored.where("bucket is null").drop("bucket", "once", "more")
    # equal sets are one class with a number of its own, so that texts which share a doc_id stay apart
    classes = materialise(
        sets.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"),
            *[F.first(c).alias(c) for c in ("n", "s1", "s2", "s3", "s4", "parity")])
        .withColumn("v", F.monotonically_increasing_id()), "classes")

    # keys are made twice, packed to find those met again, and then only these: all of them would take more than the texts
    met = stored.where("bucket is not null").select("bucket", "once", "more").groupBy("bucket").applyInArrow(_met, "met long")
    met = materialise(met, "met-keys")
    wanted = spark.sparkContext.broadcast(key_filter(met, met.count(), bucket_bits))
    again = keyed.where("doc_id is not null").select("text").mapInArrow(_key_rows(plan, wanted), "key long, d1 long, d2 long").distinct()
    listed = materialise(again.join(classes.select("d1", "d2", "v"), ["d1", "d2"]).select("key", "v"), "listed")
    named = sets.join(classes.select("d1", "d2", "v"), ["d1", "d2"]).select("doc_id", "v").distinct()
    several = materialise(listed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "lists")
    heavy = materialise(listed.where("key & 1 = 0").join(several, "key"), "heavy")
    light = listed.where("key & 1 = 1").join(several, "key").join(classes.select("v", "n"), "v")
    light = materialise(light.select("key", "v", "n"), "light")
    tops = light.groupBy("key").agg(F.min(F.struct("n", "v")).alias("low"), F.max("n").alias("high"))
    tops = materialise(tops.where("key & 2 = 0 or low.n < high").select("key", F.col("low.v").alias("u")), "tops")
    light = light.join(tops, "key").where("u <> v")
    # rows of one doc_id with different texts
    tied = named.groupBy("doc_id").agg(F.min("v").alias("u"), F.max("v").alias("w")).where("u <> w")
    tied = named.join(tied.select("doc_id", "u"), "doc_id").where("u <> v").select("u", "v")

    facts = classes.select("v", "n", "s1", "s2", "s3", "s4")
    central = materialise(heavy.groupBy("v").agg(F.sum("c").alias("weight")), "central")
    ranked = heavy.join(central, "v").groupBy("key").agg(
        F.max_by("v", F.struct("weight", -F.col("v"))).alias("u"), F.max("weight").alias("weight"))
    ranked = materialise(ranked, "centres")
    # one comparison a member, with the most central of its lists' centres; the others are left to the second pass
    stars = heavy.join(ranked, "key").where("u <> v").groupBy("v").agg(
        F.max_by("u", F.struct("weight", -F.col("u"))).alias("u"))
    stars = stars.join(facts.withColumnRenamed("v", "u").select(F.col("u"), F.struct("n", "s1", "s2", "s3", "s4").alias("a")), "u")
    stars = stars.join(facts.select("v", F.struct("n", "s1", "s2", "s3", "s4").alias("b")), "v").where(_filter(plan))
    stars = _linked(docs, stars.select("u", "v"), classes, plan)
    edges = materialise(light.select("u", "v").union(tied).union(stars).distinct(), "links")

    labels = materialise(components(edges), "labels")
    labelled = heavy.join(labels, "v", "left").select("key", "v", F.coalesce("component", "v").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(
        F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("v", F.lit(k))).alias(f"h{k}") for k in (1, 2)])
    largest = sizes.groupBy("key").agg(
        F.max_by("label", F.struct("c", "label")).alias("largest"), F.count("*").alias("labels"), F.sum("c").alias("members"),
        *[F.bit_xor(h).alias(h) for h in ("h1", "h2")]).where("labels > 1")
    # near copies share many lists; of lists with the same members one gives all the pairs
    largest = materialise(largest.groupBy("h1", "h2", "members").agg(
        F.min(F.struct("key", "largest")).alias("list")).select("list.*"), "largest")
    open_lists = materialise(labelled.join(largest, "key"), "open-lists").join(
        classes.select("v", "n", "s1", "s2", "s3", "s4", _words().alias("words")), "v")
    rest = (open_lists.where("label <> largest").alias("a").join(open_lists.alias("b"), "key")
            .where((F.col("a.label") != F.col("b.label")) & _close(plan)))
    rest = rest.select(F.least("a.v", "b.v").alias("u"), F.greatest("a.v", "b.v").alias("v")).distinct()
    rest = _linked(docs, rest, classes, plan)
    # what is left to join are the classes found so far
    joined = components(rest.join(labels.select(F.col("v").alias("u"), F.col("component").alias("cu")), "u", "left")
                        .join(labels.select("v", F.col("component").alias("cv")), "v", "left")
                        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    joined = materialise(joined, "joined").withColumnsRenamed({"v": "label", "component": "whole"})

    found = (classes.select("d1", "d2", "v", F.col("first.doc_id").alias("least")).join(labels, "v", "left")
             .withColumn("label", F.coalesce("component", "v")).join(joined, "label", "left")
             .select("d1", "d2", "least", F.coalesce("whole", "label").alias("label")))
    found = materialise(found, "class-components")
    smallest = found.groupBy("label").agg(F.min("least").alias("component_id"))     # partial: a component may be large
    found = found.join(smallest, "label").select("d1", "d2", "component_id")
    linked = sets.where("n > 0 and doc_id is not null").join(found, ["d1", "d2"]).select(
        "doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 or doc_id is null").select(
        "doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Rows of ``docs``, one document of each component: the one with the smallest ``doc_id``.

    Rows without ``doc_id`` stay; of rows that repeat the staying ``doc_id``, one stays.
    """
    found = linked_documents(docs, shingle, num, den)
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("keep_key")).select(
        F.col("doc_id").alias("keep_id"), "keep_key")
    known = docs.where("doc_id is not null")
    kept = known.join(keep, (F.col("doc_id") == F.col("keep_id")) & (text_key(F.col("text")) == F.col("keep_key")))
    kept = kept.select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def report(docs: DataFrame) -> DataFrame:
    return linked_documents(docs, 3, 9, 10).select("doc_id", "n_shingles", "component_id")

"""Ranked lexical search: the best documents of every query item by dense blocked products.

Terms that occur in items get compact numbers. One pass over the whole texts counts terms and keeps, for each
document, its length and the numbers and counts of its item terms; the counts of documents per term give the weights. A second
pass reads these rows in tiles: an item tile (weights, items x terms) times a document tile (impacts, terms x documents), one slice
of the vocabulary after the other, is a dense BLAS product in float64. Weights and impacts are whole numbers, and a
slice ends before a sum could reach 2^53, so each product is exact; slices are added up in 64-bit integers. A task keeps the best ``k``
documents of each item with all ties decided by the document id, and only those leave the task.

Items are dealt into blocks of at most ``BLOCK_ENTRIES`` (item, term) pairs, by counting; only one block's pairs are sent to the executors
at a time. A single item with more terms is a block of its own.

Defined results: null texts have no terms; documents without terms are not counted; every row of ``docs`` is a document, so
rows that share a ``doc_id`` are ranked on their own, and a null id comes last among equals; rows that share an ``item_id`` are one item
with the terms of all of them; items without known terms get no rows; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.session import materialise

TOP = 20
BLOCK_ENTRIES = 1_000_000
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 2048, 1024
EXACT = 1 << 53
#: An impact is below 10^9 * tf / (1000 * tf).
IMPACT_BELOW = 1_000_000
Array = np.ndarray

_TERM_BYTES = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(128)
) + bytes(range(128, 256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Stretches of ASCII letters and digits and of everything beyond ASCII, only A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


def _binary(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).alias("id"), F.col("text").cast("binary").alias("text"))


def item_terms(items: DataFrame, id_name: str = "item_id") -> DataFrame:
    """Stored pairs (id, term, times) of the items."""
    kind = items.schema[id_name].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "id": batch.column("id").take(pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))),
                "term": pa.array([t for c in counts for t in c], pa.binary()),
                "times": pa.array([n for c in counts for n in c.values()], pa.int64())})

    schema = T.StructType([T.StructField("id", kind), T.StructField("term", T.BinaryType()), T.StructField("times", T.LongType())])
    pairs = _binary(items, id_name).mapInArrow(work, schema)
    return materialise(pairs.groupBy("id", "term").agg(F.sum("times").alias("times")), "item-terms")


def item_blocks(pairs: DataFrame, most: int = BLOCK_ENTRIES) -> tuple[DataFrame, int]:
    """The pairs with the block of their item; blocks are split until each holds ``most`` pairs or one item."""
    blocks = max(1, -(-pairs.count() // most))
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(F.count("*").alias("n"), F.min(F.struct("id")).alias("a"), F.max(F.struct("id")).alias("z"))
        if sizes.where((F.col("n") > most) & ~F.col("a").eqNullSafe(F.col("z"))).isEmpty():
            return dealt, blocks
        blocks *= 2


@dataclass
class ItemBlock:
    """The items of a block: ids, and their pairs as (item number, term number, times)."""

    ids: pa.Array
    terms: list[bytes]
    item: Array
    term: Array
    times: Array

    @classmethod
    def collect(cls, pairs: DataFrame) -> ItemBlock:
        """Bring one block, whose size is bounded by ``item_blocks``, to the driver."""
        table = pairs.select("id", "term", "times").toArrow().combine_chunks()
        ids = table.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
        terms = table.column("term").combine_chunks().dictionary_encode()
        if isinstance(ids, pa.ChunkedArray):
            ids, terms = ids.combine_chunks(), terms.combine_chunks()
        return cls(ids.dictionary, terms.dictionary.to_pylist(), ids.indices.to_numpy().astype(np.int64),
                   terms.indices.to_numpy().astype(np.int64), table.column("times").to_numpy())


def counted_documents(docs: DataFrame, terms: list[bytes], id_name: str = "doc_id") -> DataFrame:
    """Stored rows (id, n, terms, tfs): length and the counted terms of ``terms`` of every document that has any term."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        known = number.keys()
        for batch in batches:
            rows, lengths, ends, found, counts = [], [], [0], [], []
            for i, text in enumerate(batch.column("text")):
                words = terms_of(text.as_py())
                if not words:
                    continue
                all_counts = Counter(words)
                mine = known & all_counts.keys()
                rows.append(i)
                lengths.append(len(words))
                found += [number[t] for t in mine]
                counts += [all_counts[t] for t in mine]
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            yield pa.record_batch({
                "id": batch.column("id").take(pa.array(rows, pa.int64())), "n": pa.array(lengths, pa.int64()),
                "terms": pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                "tfs": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))})

    schema = T.StructType([T.StructField("id", docs.schema[id_name].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    return materialise(_binary(docs, id_name).mapInArrow(work, schema), "counted-documents")


@dataclass
class ItemTiles:
    """Weights of a block, ready to be multiplied: columns sorted, slices that keep sums exact."""

    n_items: int
    item: Array
    term: Array
    weight: Array       # whole numbers as float64
    bounds: Array       # term numbers where slices begin, and the end
    apart: list[tuple[int, int, int]]       # (item, term, weight) too heavy for an exact product; added as integers

    @classmethod
    def build(cls, block: ItemBlock, weights: Array) -> ItemTiles:
        value = block.times * weights[block.term]
        by = np.argsort(block.term, kind="stable")
        item, term, value = block.item[by], block.term[by], value[by]
        # the largest weight of a term bounds what it can add to any item; a slice stays below 2^53 in all
        heavy = value * IMPACT_BELOW >= EXACT       # a term that one item repeats some hundred thousand times
        heaviest = np.zeros(len(weights), np.int64)
        np.maximum.at(heaviest, term[~heavy], value[~heavy])
        bounds, total = [0], 0
        for t, most in enumerate((heaviest * IMPACT_BELOW).tolist()):
            if total + most >= EXACT or t - bounds[-1] >= TILE_TERMS:
                bounds.append(t)
                total = 0
            total += most
        apart = list(zip(item[heavy].tolist(), term[heavy].tolist(), value[heavy].tolist(), strict=True))
        return cls(len(block.ids), item[~heavy], term[~heavy], value[~heavy].astype(np.float64),
                   np.array([*bounds, len(weights)]), apart)

    def scores(self, first_item: int, last_item: int, docs: Array, terms: Array, impacts: Array, n_docs: int) -> Array:
        """Exact scores (items x documents) of a tile; ``terms`` must be in ascending order."""
        out = np.zeros((last_item - first_item, n_docs), np.int64)
        for lo, hi in zip(self.bounds, self.bounds[1:], strict=False):
            i, j = np.searchsorted(self.term, (lo, hi))
            a, b = np.searchsorted(terms, (lo, hi))
            mine = (self.item[i:j] >= first_item) & (self.item[i:j] < last_item)
            if a == b or not mine.any():
                continue
            left = np.zeros((last_item - first_item, hi - lo))
            left[self.item[i:j][mine] - first_item, self.term[i:j][mine] - lo] = self.weight[i:j][mine]
            right = np.zeros((hi - lo, n_docs))
            right[terms[a:b] - lo, docs[a:b]] = impacts[a:b]
            out += (left @ right).astype(np.int64)
        for item, term, weight in self.apart:
            if first_item <= item < last_item:
                a, b = np.searchsorted(terms, (term, term + 1))
                out[item - first_item, docs[a:b]] += weight * impacts[a:b]
        return out


class Best:
    """The best ``k`` documents of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.least = np.zeros(n_items, np.int64)     # scores that are not above zero never count
        self.score = [np.zeros(0, np.int64)] * n_items
        self.doc = [np.zeros(0, np.int64)] * n_items
        self.null = [np.zeros(0, bool)] * n_items

    def offer(self, first_item: int, scores: Array, doc: Array, null: Array) -> None:
        floor = np.maximum(self.least[first_item:first_item + len(scores)], 1)
        for row in np.flatnonzero(scores.max(axis=1, initial=0) >= floor):
            at = np.flatnonzero(scores[row] >= floor[row])       # equal scores may have smaller ids
            i = first_item + row
            score = np.r_[self.score[i], scores[row][at]]
            docs, nulls = np.r_[self.doc[i], doc[at]], np.r_[self.null[i], null[at]]
            by = np.lexsort((docs, nulls, -score))[:self.k]
            self.score[i], self.doc[i], self.null[i] = score[by], docs[by], nulls[by]
            if len(by) == self.k:
                self.least[i] = self.score[i][-1]


def length_factors(n: Array, n_docs: int, total: int) -> Array:
    """100 - 25 + (25 * n * N) div L in whole numbers, also where the product passes 64 bits."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * n_docs // total for x in n], np.int64)
    return 75 + 25 * n * n_docs // total


def best_documents(counted: DataFrame, block: ItemBlock, k: int = TOP) -> DataFrame:
    """(id of the item, rank, id of the document, score) for the items of one block."""
    spark = counted.sparkSession
    totals = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    holders = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())   # bounded by the block
    n_docs, total = totals["docs"], totals["words"] or 0
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) if t in holders else 0
                        for t in range(len(block.terms))], np.int64)
    sent = spark.sparkContext.broadcast(ItemTiles.build(block, weights))
    kind = counted.schema["id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = sent.value
        best = Best(tiles.n_items, k)
        for batch in batches:
            for at in range(0, len(batch), TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                lists = part.column("terms")
                sizes = np.diff(lists.offsets.to_numpy())
                term, tf = lists.flatten().to_numpy().astype(np.int64), part.column("tfs").flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(part)), sizes)
                m = length_factors(part.column("n").to_numpy(), n_docs, total)[doc]
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
                by = np.argsort(term, kind="stable")
                doc, term, impact = doc[by], term[by], impact[by]
                ids = part.column("id")
                plain, null = ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False)
                for first in range(0, tiles.n_items, TILE_ITEMS):
                    last = min(first + TILE_ITEMS, tiles.n_items)
                    best.offer(first, tiles.scores(first, last, doc, term, impact, len(part)), plain, null)
        sizes = [len(s) for s in best.score]
        if sum(sizes):
            yield pa.record_batch({
                "item": pa.array(np.repeat(np.arange(tiles.n_items), sizes), pa.int64()),
                "doc_id": pa.array(np.concatenate(best.doc), pa.int64(), mask=np.concatenate(best.null)),
                "score": pa.array(np.concatenate(best.score), pa.int64())})

    found = counted.mapInArrow(work, "item long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # the best of every task are cut to k on the map side, then in groups of tasks, then in all
    groups = max(1, math.isqrt(n_docs // TILE_DOCS))
    found = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    for names in (["item", "group"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where(F.col("rank") <= k)
    found = materialise(found.select("item", "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score"), "best-documents")
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(block.ids)), pa.int64()), "item_id": block.ids}))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")    # bounded by the block


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank, doc_id, score."""
    pairs, blocks = item_blocks(item_terms(items), block_entries)
    out = None
    for b in range(blocks):
        block = ItemBlock.collect(pairs.where(F.col("block") == b) if blocks > 1 else pairs)
        if len(block.ids) or out is None and b == blocks - 1:
            part = best_documents(counted_documents(docs, block.terms), block, k)
            out = part if out is None else out.unionByName(part)
    return out.select("item_id", "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns of ``ranked``."""
    return ranked(docs, items)

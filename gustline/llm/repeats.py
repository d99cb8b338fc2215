"""Removal of long strings that occur more than once in the corpus.

A byte goes if a string of ``length`` bytes that starts at two or more places covers it. In the order of all
suffixes, the places of such a string stand side by side, and the longest previous factor of a place
reaches ``length`` exactly if a smaller place stands in its run. So only this threshold of the
longest-previous-factor array is needed, and the runs can be found by grouping instead of one global sort of all
suffixes, which would hold eight bytes or more for every byte of text:

1. Each window of ``length`` bytes has an anchor: the place of the smallest hash of eight bytes among its first
   ``REACH`` places. Equal windows have equal anchors at equal distances, so the neighbourhood of an anchor that
   lies in all its windows is a key, and windows whose anchor's key is unique cannot repeat. Only
   one row per anchor (one in about 128 bytes) is shuffled.
2. Anchors whose windows span equal bytes form one run class; in a class of two or more, every window repeats. Neighbouring
   anchors of one class (in text of a short period) are one row.
3. Of classes that share the key but not the whole span, one span each goes on. Its windows, numbered by their distance
   from the anchor, are cut into ranges of ``WIDTHS`` windows, from wide to narrow. The bytes that lie in all
   windows of a range are its key, its whole bytes its class, and again a class of two repeats and a range alone with its key does not. Only ranges that share
   the key but not the class are cut further, so that about twenty rows find the edge of a repeated passage. Every step groups rows by digests, whatever their number:
   no task holds a group. What no other place shares stays.

``keep_first`` leaves the first place of each string (smaller ``doc_id``, then smaller offset), which is what the
longest previous factor alone marks; without it, the next factor counts as well and all places go.

Defined results: a null text counts as an empty one; matches never cross documents; rows that share a ``doc_id``
are told apart by their text; equal rows are copies of each other, and in ``keep_first`` order they
count as one; an empty table gives an empty result; other columns are not looked at. Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.session import materialise

LENGTH = 400
REACH = 320
GRAM = 8
WIDTHS = (40, 5, 1)     # windows of a range, of spans of up to REACH
ANCHORS = "doc_id long, text_key long, lo int, hi int, end int, n int, at int, key long, f1 long, f2 long"
SPANS = "doc_id long, text_key long, lo int, hi int, at int, alone boolean, bytes binary"
RANGES = "span long, doc_id long, text_key long, lo int, hi int, alone boolean, key long, f1 long, f2 long"
RESULT = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors_of(text: bytes, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: place, and first and last start of the windows that share it."""
    starts = len(text) - length + 1
    if starts <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    n = starts + reach - 1
    x = np.ndarray((n,), "<u8", text, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x &= np.uint64(0xFFFFFFFF00000000)
    x |= np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    best = np.minimum(ahead[:starts], behind[reach - 1:reach - 1 + starts]) & np.uint64(0xFFFFFFFF)
    cut = np.flatnonzero(np.diff(best)) + 1
    lo = np.concatenate(([0], cut))
    hi = np.concatenate((cut - 1, [starts - 1]))
    return best[lo].astype(np.int64), lo, hi


def _digests(pieces: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(p) for p in pieces]), "<i8").reshape(-1, 2)


def _anchor_rows(length: int, reach: int):
    shared = length - reach + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                counts, columns, keys, spans = [], [], [], []
                for text in some.column("text"):
                    data = text.as_buffer().to_pybytes()
                    place, lo, hi = anchors_of(data, length, reach)
                    counts.append(len(lo))
                    columns.append((lo, hi, place))
                    keys += [xxhash.xxh3_64_intdigest(data[a:a + shared]) for a in place.tolist()]
                    spans += [data[i:j + length] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                if not keys:
                    continue
                which = np.repeat(np.arange(len(counts)), counts)
                lo, hi, place = (np.concatenate(c).astype(np.int32) for c in zip(*columns, strict=True))
                digests, key = _digests(spans), np.array(keys, np.uint64).view(np.int64)
                mark = np.column_stack([which, key, digests])
                runs = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]).any(axis=1))))
                ends = np.append(runs[1:], len(lo))
                which = pa.array(which[runs])
                yield pa.record_batch(
                    [some.column("doc_id").take(which), some.column("text_key").take(which), pa.array(lo[runs]), pa.array(hi[runs]),
                     pa.array(hi[ends - 1]), pa.array((ends - runs).astype(np.int32)), pa.array(place[runs]),
                     pa.array(key[runs]), pa.array(digests[runs, 0]), pa.array(digests[runs, 1])],
                    names=["doc_id", "text_key", "lo", "hi", "end", "n", "at", "key", "f1", "f2"])

    return rows


def _span_rows(length: int):
    """The bytes of each wanted span, out of its text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column("text")[k].as_buffer().to_pybytes()
                spans = batch.column("spans")[k].values
                lo, hi = (spans.field(c).to_pylist() for c in ("lo", "hi"))
                same = pa.array(np.zeros(len(spans), np.int32))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(k, 1).take(same), batch.column("text_key").slice(k, 1).take(same),
                     spans.field("lo"), spans.field("hi"), spans.field("at"), spans.field("alone"),
                     pa.array([data[i:j + length] for i, j in zip(lo, hi, strict=True)], pa.binary())],
                    names=["doc_id", "text_key", "lo", "hi", "at", "alone", "bytes"])

    return rows


def _range_rows(length: int, width: int):
    """The wanted windows of each span in ranges of ``width``, counted from the anchor, each with its key and digest."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                which, los, his, alones, keys, pieces = [], [], [], [], [], []
                columns = (some.column(c).to_pylist() for c in ("lo", "at", "bytes", "wanted"))
                for k, (first, at, data, wanted) in enumerate(zip(*columns, strict=True)):
                    for r in wanted:
                        for j in range((at - r["hi"]) // width, (at - r["lo"]) // width + 1):
                            # windows that start j * width to (j + 1) * width - 1 before the anchor
                            latest = at - j * width
                            lo, hi = max(r["lo"], latest - width + 1), min(r["hi"], latest)
                            which.append(k)
                            los.append(lo)
                            his.append(hi)
                            alones.append(r["alone"])
                            keys.append(xxhash.xxh3_64_intdigest(data[latest - first:latest - width + 1 + length - first], j))
                            pieces.append(b"%d,%d;" % (at - lo, at - hi) + data[lo - first:hi + length - first])
                if not which:
                    continue
                digests, which = _digests(pieces), pa.array(which)
                yield pa.record_batch(
                    [*[some.column(c).take(which) for c in ("span", "doc_id", "text_key")], pa.array(los, pa.int32()),
                     pa.array(his, pa.int32()), pa.array(alones), pa.array(np.array(keys, np.uint64).view(np.int64)),
                     pa.array(digests[:, 0]), pa.array(digests[:, 1])],
                    names=["span", "doc_id", "text_key", "lo", "hi", "alone", "key", "f1", "f2"])

    return rows


def _cut_rows(length: int, with_text: bool):
    def cut(data: bytes, starts: np.ndarray) -> tuple[bytes, int, int]:
        """What is left, bytes removed, spans removed; starts: (first, last) of windows that repeat."""
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, starts[:, 0], 1)
        np.add.at(change, starts[:, 1] + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(np.count_nonzero(gone)), spans

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                data = text.as_buffer().to_pybytes()
                kept, removed, spans = data, 0, 0
                if starts.is_valid and len(starts):
                    kept, removed, spans = cut(data, np.stack(
                        [starts.values.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi")], axis=1))
                out.append((kept.decode("utf-8", "ignore") if with_text else None, len(data), removed, spans,
                            hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                                  names=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _beside_text(docs: DataFrame, per_document: DataFrame, how: str) -> DataFrame:
    """Texts with what is known of each document: both are shuffled, and the texts streamed past the smaller table."""
    texts, known = _keyed(docs).alias("t"), per_document.hint("shuffle_hash").alias("k")
    joined = texts.join(known, F.col("t.doc_id").eqNullSafe(F.col("k.doc_id"))
                        & (F.col("t.text_key") == F.col("k.text_key")), how)
    return joined.select("t.doc_id", "t.text_key", "t.text",
                         *[F.col(f"k.{c}") for c in per_document.columns if c not in ("doc_id", "text_key")])


def _merged(starts: DataFrame) -> DataFrame:
    """doc_id, text_key, starts: ranges of each document in order, those that touch made one."""
    listed = starts.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))

    def add(done, r):
        last = F.element_at(done, -1)
        longer = F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi")))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["hi"] + 1 >= r["lo"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(r)))

    none = F.array().cast("array<struct<lo:int,hi:int>>")
    return listed.select("doc_id", "text_key", F.aggregate("r", none, add).alias("starts"))


def _mixed(classes: DataFrame, keep_first: bool) -> DataFrame:
    """Keys of several classes of which one at least is not settled."""
    open_classes = F.lit(True) if keep_first else (F.col("copies") == 1) & F.col("first.alone")
    return (classes.groupBy("key").agg(F.count("*").alias("n"), F.max(open_classes).alias("open"))
            .where("n > 1 and open").select("key"))


def _narrowed(spans: DataFrame, length: int, keep_first: bool, reach: int) -> list[DataFrame]:
    """Ranges of starts of repeated windows within spans that share keys, width after width."""
    found = []
    wanted = spans.withColumn("wanted", F.array(F.struct("lo", "hi", "alone")))
    for width in [w for w in WIDTHS if w == 1 or w < reach]:
        wanted = wanted.select("span", "doc_id", "text_key", "lo", "at", "bytes", "wanted")
        ranges = materialise(wanted.mapInArrow(_range_rows(length, width), RANGES), f"ranges-{width}")
        place = F.struct("doc_id", "text_key", "lo", "hi", "span", "alone")
        classes = materialise(ranges.groupBy("key", "f1", "f2").agg(F.count("*").alias("copies"), F.min(place).alias("first")),
                              f"range-classes-{width}")
        again = ranges.where("alone").join(classes.where("copies > 1"), ["key", "f1", "f2"])
        if keep_first:
            again = again.where(~F.struct("doc_id", "text_key", "lo").eqNullSafe(
                F.struct("first.doc_id", "first.text_key", "first.lo")))
        found.append(again.select("doc_id", "text_key", "lo", "hi"))
        if width > 1:
            alone = F.lit(True) if keep_first else (F.col("copies") == 1) & F.col("first.alone")
            left = classes.join(_mixed(classes, keep_first), "key").groupBy(F.col("first.span").alias("span")).agg(
                F.collect_list(F.struct("first.lo", "first.hi", alone.alias("alone"))).alias("wanted"))
            wanted = spans.join(left, "span")
    return found


def repeated_starts(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc_id, text_key, starts: for each document with repeats, ranges (lo, hi) of starts of repeated windows.

    The ranges of a document are no more than its anchors and windows.
    """
    reach = max(1, min(REACH, length - GRAM))
    long_enough = _keyed(docs).where(F.octet_length("text") >= length)
    anchors = materialise(long_enough.mapInArrow(_anchor_rows(length, reach), ANCHORS), "anchors")
    shared = anchors.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    anchors = materialise(anchors.join(shared, "key", "left_semi"), "shared-anchors")

    place = F.struct("doc_id", "text_key", "lo", "hi", "at", F.lit(True).alias("alone"))
    classes = materialise(anchors.groupBy("key", "f1", "f2").agg(F.sum("n").alias("copies"), F.min(place).alias("first")),
                          "run-classes")
    apart = classes.join(_mixed(classes, keep_first), "key").select(
        "first.doc_id", "first.text_key", "first.lo", "first.hi", "first.at",
        ((F.col("copies") == 1) | F.lit(keep_first)).alias("alone"))
    listed = apart.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi", "at", "alone")).alias("spans"))
    spans = _beside_text(docs, listed, "inner").mapInArrow(_span_rows(length), SPANS)
    spans = materialise(spans.withColumn("span", F.monotonically_increasing_id()), "spans")

    whole = anchors.join(classes.where("copies > 1").select("key", "f1", "f2", "first"), ["key", "f1", "f2"])
    lo = F.col("lo")
    if keep_first:
        is_first = F.struct("doc_id", "text_key", "lo").eqNullSafe(F.struct("first.doc_id", "first.text_key", "first.lo"))
        lo = F.when(is_first, F.col("hi") + 1).otherwise(lo)
        whole = whole.where(~is_first | (F.col("n") > 1))
    found = whole.select("doc_id", "text_key", lo.alias("lo"), F.col("end").alias("hi"))
    for some in _narrowed(spans, length, keep_first, reach):
        found = found.unionByName(some)
    return materialise(_merged(found), "starts")


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, with_text: bool = True) -> DataFrame:
    """One row per document row: doc_id, text (what is left), n_bytes, n_removed, n_spans, kept_sha256.

    A cut inside a character leaves bytes that are no text; ``text`` drops those, the digest keeps them.
    """
    starts = repeated_starts(docs, length, keep_first)
    return _beside_text(docs, starts, "left").select("doc_id", "text", "starts").mapInArrow(
        _cut_rows(length, with_text), RESULT)


def report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, with_text=False).drop("text")

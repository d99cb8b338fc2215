"""Periodic runs of words: stretches that repeat a period four times or more, found by internal pattern matching.

A task takes documents in batches. Word ids of a batch stand in one array (a mark behind each document is unlike any
word, and words of two documents differ), over which prefix doubling gives the suffix array and, for each k,
the class of every stretch of 2^k words, which is an interval of the suffix array. Blocks of 2^k words at
multiples of 2^k are then looked up in the window behind them: the next occurrence is the range successor in
the interval of the block, found in a wavelet tree over the suffix array. Occurrences at most half a block apart form
an arithmetic progression, so a few queries describe all of them, and the ends of the stretch with the progression's difference
say which member can be a period. Every candidate (place, period) is extended by the stored classes to both sides, and
kept if it is long enough; of runs with the same ends the smallest period is the run's.

Why no run is missed: for a period p take the largest b = 2^k with 2b - 1 <= 3p. A run of at least 4p words holds a whole
block of b words that has another occurrence p words on, still in the run, and p lies in [(2b-1)/3, (4b-1)/3).

Everything happens inside one pass over the documents, without a shuffle. Memory follows the batch (``BATCH_WORDS`` words, or one
longer document) times the binary logarithm of its longest repeat.

Defined results: a null or empty text, or one of white space, has no words, no runs and the digests of empty strings; rows are
independent, so repeated rows get equal results; other columns are not looked at, whatever their names. In the report a null
``doc_id`` replaces no words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 1 << 17
MIN_LENGTH = 6
MIN_REPEATS = 4
Array = np.ndarray


class StretchClasses:
    """Classes of all stretches of 2^k words, k = 0, 1, …, by prefix doubling.

    ``levels[k][i]`` is the first place of the class of ``words[i:i + 2**k]`` in the suffix array, so equal stretches have equal
    numbers and suffixes that start with one are the interval of its class. Doubling ends when no stretch repeats.
    """

    def __init__(self, words: Array) -> None:
        self.n = n = len(words)
        order = np.argsort(words, kind="stable")
        self.levels: list[Array] = [self._first_places(words[order], order)]
        self.order = order
        k = 0
        while True:
            rank = self.levels[k]
            tied = self._tied(rank)
            if not len(tied):
                break
            # places of the suffix array that still share a class are sorted by the class 2^k words on
            at = self.order[tied]
            ahead = at + (1 << k)
            second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1).astype(np.int64)
            by = np.lexsort((second, rank[at]))
            self.order[tied] = at[by]
            first, second = rank[at][by], second[by]
            new = rank.copy()
            starts = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
            new[at[by]] = tied[np.maximum.accumulate(np.where(starts, np.arange(len(tied)), 0))]
            self.levels.append(new)
            k += 1

    def _first_places(self, ordered: Array, order: Array) -> Array:
        starts = np.r_[True, ordered[1:] != ordered[:-1]]
        rank = np.empty(self.n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(starts, np.arange(self.n), 0))
        return rank

    def _tied(self, rank: Array) -> Array:
        """Places of the suffix array whose class has several members."""
        ordered = rank[self.order]
        same = ordered[1:] == ordered[:-1]
        return np.flatnonzero(np.r_[same, False] | np.r_[False, same])

    def sizes(self, k: int) -> Array:
        """Members of the class of every place of the suffix array that starts one; zero elsewhere."""
        return np.bincount(self.levels[k], minlength=self.n)

    def forward(self, i: Array, j: Array) -> Array:
        """Length of the longest common stretch from ``i`` and from ``j``."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            inside = (i < self.n) & (j < self.n)
            same = inside & (self.levels[k][np.minimum(i, self.n - 1)] == self.levels[k][np.minimum(j, self.n - 1)])
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def backward(self, i: Array, j: Array) -> Array:
        """Length of the longest common stretch that ends before ``i`` and before ``j``."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            same = (a >= 0) & (b >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])
            i[same] -= 1 << k
            j[same] -= 1 << k
        return start - i


class WaveletTree:
    """Range successor over an array of distinct non-negative numbers, for many queries at once.

    Level by level the numbers are parted by their next bit, in stable order; a level keeps how many zeros stand before each place.
    """

    def __init__(self, values: Array, below: int) -> None:
        self.depth = max(1, int(below).bit_length())
        self.zeros: list[Array] = []
        now = values
        for bit in range(self.depth - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~ones)])
            now = np.concatenate([now[~ones], now[ones]])

    def _below(self, left: Array, right: Array, limit: Array) -> Array:
        """How many numbers of [left, right) are smaller than ``limit``."""
        found = np.zeros(len(left), np.int64)
        for step, zeros in enumerate(self.zeros):
            one = (limit >> (self.depth - 1 - step) & 1).astype(bool)
            zl, zr, total = zeros[left], zeros[right], zeros[-1]
            found += np.where(one, zr - zl, 0)
            left, right = np.where(one, total + left - zl, zl), np.where(one, total + right - zr, zr)
        return found

    def successor(self, left: Array, right: Array, limit: Array) -> Array:
        """The smallest number of [left, right) that is not below ``limit``, or -1."""
        out = np.full(len(left), -1, np.int64)
        fits = limit < (1 << self.depth)
        skip = np.zeros(len(left), np.int64)
        skip[fits] = self._below(left[fits], right[fits], limit[fits])
        some = np.flatnonzero(fits & (skip < right - left))
        left, right, skip = left[some], right[some], skip[some]
        value = np.zeros(len(some), np.int64)
        for step, zeros in enumerate(self.zeros):       # the number of rank ``skip``
            zl, zr, total = zeros[left], zeros[right], zeros[-1]
            one = skip >= zr - zl
            skip = np.where(one, skip - (zr - zl), skip)
            value |= one.astype(np.int64) << (self.depth - 1 - step)
            left, right = np.where(one, total + left - zl, zl), np.where(one, total + right - zr, zr)
        out[some] = value
        return out


def _candidates(classes: StretchClasses) -> tuple[Array, Array]:
    """Places and periods that some block and its occurrences in the window behind it suggest."""
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(classes.levels) < 2:
        return places[0], periods[0]
    n = classes.n
    # only suffixes that share two words with another one can answer
    shared = classes.sizes(1)[classes.levels[1][classes.order]] > 1
    place = np.r_[0, np.cumsum(shared)]
    tree = WaveletTree(classes.order[shared], n)

    def note(at: Array, period: Array, fits: Array) -> None:
        places.append(at[fits])
        periods.append(period[fits])

    for k in range(1, len(classes.levels)):
        b = 1 << k
        s = np.arange(0, n, b)
        size = classes.sizes(k)[classes.levels[k][s]]
        s = s[size > 1]
        if not len(s):
            continue
        first = classes.levels[k][s]
        left, right = place[first], place[first + classes.sizes(k)[first]]
        lo, hi = -(-(2 * b - 1) // 3), -(-(4 * b - 1) // 3) - 1
        ask = s + lo
        while len(s):
            x = tree.successor(left, right, ask)
            live = (x >= 0) & (x <= s + hi)
            s, left, right, x = s[live], left[live], right[live], x[live]
            if not len(s):
                break
            note(s, x - s, np.full(len(s), True))
            y = tree.successor(left, right, x + 1)
            step = y - x
            row = (y >= 0) & (step <= b // 2)           # a progression; else x stands alone
            ask = x + 1
            if row.any():
                sr, xr, d = s[row], x[row], step[row]
                note(sr, d, np.full(len(sr), True))
                end = xr + classes.forward(xr, xr + d)        # where the period d ends, for all members
                for p in (end - (sr + classes.forward(sr, sr + d)),
                          (xr - classes.backward(xr, xr + d)) - (sr - classes.backward(sr, sr + d))):
                    note(sr, p, (p >= lo) & (p <= hi))
                ask[row] = np.maximum(xr + 1, end + d - b + 1)      # behind its last member
    return np.concatenate(places), np.concatenate(periods)


def runs_of(words: Array, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> tuple[Array, Array, Array]:
    """Start, length and smallest period of all runs in an array of word ids, by start, then period.

    ``min_repeats`` below 4 would need a denser choice of blocks and is refused.
    """
    if min_repeats < MIN_REPEATS:
        raise ValueError(f"runs of fewer than {MIN_REPEATS} repeats are not looked for")
    none = (np.zeros(0, np.int64),) * 3
    if len(words) < min_length:
        return none
    classes = StretchClasses(words)
    at, p = _candidates(classes)
    if not len(at):
        return none
    at, p = np.unique(np.stack([at, p]), axis=1)
    inside = at + p < len(words)
    at, p = at[inside], p[inside]
    start = at - classes.backward(at, at + p)
    end = at + classes.forward(at, at + p) + p
    keep = end - start >= np.maximum(min_length, min_repeats * p)
    start, end, p = start[keep], end[keep], p[keep]
    by = np.lexsort((p, end, start))
    start, end, p = start[by], end[by], p[by]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, end, p = start[new], end[new], p[new]
    by = np.lexsort((p, start))
    return start[by], (end - start)[by], p[by]


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or b"").split()


def repeat_tail(doc_id: int | None, n: int) -> Array | None:
    """Which original word stands at each place of the report's changed documents; None where nothing changes."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def runs_of_documents(lists: list[list[bytes]]) -> list[tuple[Array, Array, Array]]:
    """Runs of each of several documents, looked for together."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    parts, ends, total = [], [], 0
    for words in lists:
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        total += len(words) + 1
        ends.append(total)
    marked = np.empty(total, np.int64)
    begin = 0
    for i, (part, end) in enumerate(zip(parts, ends, strict=True)):
        marked[begin:end - 1] = part + i * (len(ids) + 1)
        marked[end - 1] = i * (len(ids) + 1) + len(ids)
        begin = end
    start, length, period = runs_of(marked)
    cuts = np.searchsorted(start, np.r_[0, ends])
    begins = [0, *ends]
    return [(start[i:j] - b, length[i:j], period[i:j]) for i, j, b in zip(cuts, cuts[1:], begins, strict=False)]


def kept_words(n: int, runs: tuple[Array, Array, Array]) -> Array:
    """False for words that repeat what a run has said once."""
    start, length, period = runs
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:n] == 0


REPORT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _documents(batches: Iterator[pa.RecordBatch], changed: bool) -> Iterator[tuple[list, list, list]]:
    """Ids, words and runs of up to ``BATCH_WORDS`` words at a time; a longer document is alone."""
    ids, lists, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = words_of(text.as_py())
            source = repeat_tail(doc, len(words)) if changed else None
            if source is not None:
                words = [words[j] for j in source.tolist()]
            if held and held + len(words) + 1 > BATCH_WORDS:
                yield ids, lists, runs_of_documents(lists)
                ids, lists, held = [], [], 0
            ids.append(doc)
            lists.append(words)
            held += len(words) + 1
    if ids:
        yield ids, lists, runs_of_documents(lists)


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_runs): texts whose runs keep their first period, words joined by one space; nulls are empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists, found in _documents(batches, changed=False):
            texts = [b" ".join(np.array(w, object)[kept_words(len(w), r)].tolist()) if len(r[0]) else b" ".join(w)
                     for w, r in zip(lists, found, strict=True)]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string()),
                                   "n_runs": pa.array([len(r[0]) for r in found], pa.int64())})

    return _binary(docs).mapInArrow(work, "doc_id long, text string, n_runs long")


def runs(docs: DataFrame) -> DataFrame:
    """One row per run: doc_id, start (word number), length, period."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _documents(batches, changed=False):
            sizes = [len(r[0]) for r in found]
            yield pa.record_batch({
                "doc_id": pa.array([d for d, n in zip(ids, sizes, strict=True) for _ in range(n)], pa.int64()),
                **{name: pa.array(np.concatenate([r[i] for r in found]) if found else [], pa.int64())
                   for i, name in enumerate(("start", "length", "period"))}})

    return _binary(docs).mapInArrow(work, "doc_id long, start long, length long, period long")


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest columns; the words of one document in ten are replaced by a repeating tail first."""
    def row(doc: int | None, words: list[bytes], found: tuple[Array, Array, Array]) -> tuple:
        n = len(found[0])
        if not n:
            return doc, 0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
        start, length, period = (x.tolist() for x in found)
        best = min(range(n), key=lambda i: (-length[i], start[i], period[i]))
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in zip(start, length, period, strict=True))
        left = np.array(words, object)[kept_words(len(words), found)].tolist()
        return (doc, n, start[best], length[best], period[best], 1000 * length[best] // period[best],
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [part.split()[0] for part in REPORT.split(", ")]
        for ids, lists, found in _documents(batches, changed=True):
            columns = zip(*map(row, ids, lists, found), strict=True)
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return _binary(docs).mapInArrow(work, REPORT)

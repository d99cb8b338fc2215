"""Lexical search, nearest neighbours and runs of words against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustline.llm import lexical_search, prefix_forest, word_runs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


# -- lexical search ---------------------------------------------------------------------------
def ranked_by_hand(docs, items, k=20):
    counted = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    holders = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(Counter)
    for item, text in items:
        wanted[item].update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "Alpha beta, BETA naïve"), (2, None), (3, ""), (4, "one"), (5, "absent words only"), (6, "épée zwölf x1 alpha " * 40),
         (None, "gamma"), (7, "delta"), (7, "you idiot")]


@pytest.mark.parametrize("entries", [1_000_000, 3])
def test_search_of_odd_rows(spark, odd_docs, odd_rows, entries):
    items = spark.createDataFrame([(*i, 1, 2) for i in ITEMS], "item_id long, text string, term int, score int")
    assert got(lexical_search.ranked(odd_docs, items, block_entries=entries)) == ranked_by_hand([r[:2] for r in odd_rows], ITEMS)


def test_search_with_ties_over_many_tiles(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.choice([3, 4, 30]))) for _ in range(40)]
    docs = [(i, texts[i % 40] if i % 3 else texts[0]) for i in range(3000)]     # a third of all rows has one text
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))) for i in range(30)]
    have = got(lexical_search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                                     spark.createDataFrame(items, "item_id long, text string")))
    assert have == ranked_by_hand(docs, items)


def test_search_of_empty_tables(spark, odd_docs, empty_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(lexical_search.ranked(empty_docs, items)) == []
    assert got(lexical_search.ranked(odd_docs, items.where("false"))) == []


def test_products_stay_exact():
    """Weights near the limit of a slice, and one beyond it, against whole numbers."""
    rng = np.random.default_rng(4)
    times = rng.integers(1, 200_000, 60)
    times[7] = 10**7
    owner = rng.integers(0, 3, 50)
    block = lexical_search.ItemBlock(list(range(3)), [b"t"] * 50, np.r_[owner, (owner[:10] + 1) % 3], np.r_[np.arange(50), np.arange(10)], times)
    weights = rng.integers(20_000, 40_000, 50)
    tiles = lexical_search.ItemTiles.build(block, weights)
    assert tiles.apart and len(tiles.bounds) > 2
    docs, terms = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(50)))
    by = np.argsort(terms, kind="stable")
    impacts = rng.integers(1, 10**6, 250)
    want = [[0] * 5 for _ in range(3)]
    for i, t, n in zip(block.item.tolist(), block.term.tolist(), times.tolist()):
        for d, u, v in zip(docs.tolist(), terms.tolist(), impacts.tolist()):
            if t == u:
                want[i][d] += n * int(weights[t]) * v
    assert tiles.scores(0, 3, docs[by], terms[by], impacts[by], 5).tolist() == want


# -- nearest neighbours -------------------------------------------------------------------------
def near_by_hand(rows, k=20, every=20):
    vectors = defaultdict(set)
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vectors[i].add(tuple(float(np.float32(x)) for x in v) + (0.0,) * (8 - len(v)))
    out = {}
    for q in vectors:
        if q % every == 0:
            best = []
            for i in vectors:
                if i != q:
                    best.append((-max(float((np.array(a) * np.array(b)).sum()) for a in vectors[q] for b in vectors[i]), i))
            out[q] = [(i, -s) for s, i in sorted(best)[:k]]
    return out


def vector_rows(n=400):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8) * rng.choice([0.2, 1.0, 3.0]))]) for i in range(n)]
    hot = rows[3][1]
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]
    return rows + rows[:5] + [(None, hot), (1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] + [1.0] * 7), (1080, [float("inf")] * 8),
                              (1100, [None, 1.0, 1.0]), (1120, [1.0, -0.0, 0.5]), (1121, [1.0, 0.0, 0.5, 0.0]), (20, [0.5] * 8)]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, cls int, score double, query int, digest string")


def answers(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.query_id][r.rank] = (r.vec_id, r.score)
    assert all(sorted(a) == list(range(1, len(a) + 1)) for a in out.values())
    return {q: [a[i] for i in sorted(a)] for q, a in out.items()}


@pytest.mark.parametrize("chunk_rows", [50, 20_000])
def test_forest_that_climbs_to_the_root_is_exact(spark, chunk_rows):
    rows = vector_rows()
    have = answers(prefix_forest.nearest(vectors_of(spark, rows), F.col("id") % 20 == 0, trees=2, wanted=10**9, chunk_rows=chunk_rows))
    want = near_by_hand(rows)
    assert have.keys() == want.keys()
    for q in want:
        assert [i for i, _ in have[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in have[q]], [s for _, s in want[q]], atol=1e-12)


def test_forest_finds_most_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    have = answers(prefix_forest.nearest(df, F.col("id") % 20 == 0, chunk_rows=500))
    x = np.array([v for _, v in rows])
    hits = 0
    for q, found in have.items():
        product = x @ x[q]
        product[q] = -np.inf
        hits += len({i for i, _ in found} & set(np.argsort(-product)[:20].tolist()))
    assert len(have) == 150 and hits >= 0.9 * 20 * 150


def test_prefix_sizes_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(600)]
    classes, _ = prefix_forest.classes_of(prefix_forest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"),
                                          F.col("id") % 20 == 0, 20)
    stored = {r.cls: (r.ids[0], np.array(r.v), r.asks) for r in classes.collect()}
    forest = prefix_forest.Forest(4, max(np.linalg.norm(v) for _, v, _ in stored.values()), 3)
    cls = np.array(list(stored))
    keys = forest.keys(np.array([stored[c][1] for c in cls]), cls) >> prefix_forest.TAIL_BITS
    chunks = prefix_forest.chunk_borders(classes, forest, 600, 70)
    for r in prefix_forest.prefix_sizes(classes, forest, chunks).collect():
        mine = forest.strings(stored[r.cls][1][None, :], query=True)[0] >> prefix_forest.TAIL_BITS
        want = [int(((keys >> (prefix_forest.HASH_BITS - n)) == (mine >> (prefix_forest.HASH_BITS - n))).sum()) for n in range(prefix_forest.HASH_BITS + 1)]
        assert stored[r.cls][2] and r.sizes == want


def test_forest_of_few_or_no_vectors(spark):
    two = vectors_of(spark, [(0, [1.0, 2.0]), (20, [2.0, 1.0])])
    assert answers(prefix_forest.report(two)) == {0: [(20, 4.0)], 20: [(0, 4.0)]}
    assert answers(prefix_forest.report(two.where("vec_id = 0"))) == {}
    assert answers(prefix_forest.report(two.where("false"))) == {}


# -- runs of words ------------------------------------------------------------------------------
def runs_by_hand(x, least=6, repeats=4):
    found = {}
    for p in range(1, len(x) // repeats + 1):
        i = 0
        while i + p < len(x):
            if x[i] != x[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                found[i, j + p] = min(p, found.get((i, j + p), p))
            i = j + 1
    return sorted((i, j - i, p) for (i, j), p in found.items())


def collapsed_by_hand(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_report_by_hand(doc, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed_by_hand(words, found).encode()).hexdigest())


def test_runs_of_made_up_sequences():
    rng = random.Random(11)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 6)):
            k, x = rng.randint(1, 4), []
            for _ in range(rng.randint(0, 6)):
                x += [rng.randrange(k) for _ in range(rng.randint(1, rng.choice([3, 12, 30])))] * rng.randint(1, 7)
                x += [rng.randrange(k + 1) for _ in range(rng.randint(0, 4))]
            docs.append([str(v).encode() for v in (x[:20] * rng.randint(1, 8) + x[:5] if rng.random() < 0.3 else x)])
        for words, found in zip(docs, word_runs.runs_of_documents(docs)):
            assert list(zip(*(x.tolist() for x in found))) == runs_by_hand(words)


def test_runs_of_one_word_and_of_a_long_period():
    start, length, period = word_runs.runs_of(np.zeros(100_000, np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [100_000], [1])
    start, length, period = word_runs.runs_of(np.r_[7, np.tile(np.r_[np.zeros(4999, np.int64), 1], 5)])
    assert (1, 25_000, 5000) in set(zip(start.tolist(), length.tolist(), period.tolist()))
    with pytest.raises(ValueError):
        word_runs.runs_of(np.zeros(9, np.int64), min_repeats=2)


def test_run_report(spark, odd_docs, odd_rows, small_docs):
    for df, rows in ((odd_docs, [r[:2] for r in odd_rows if len(r[1] or "") < 50_000]),
                     (small_docs, [(r.doc_id, r.text) for r in small_docs.collect()])):
        have = [tuple(r) for r in word_runs.report(df).collect() if rows[0][0] != 1 or r.doc_id != 5]
        assert sorted(have, key=repr) == sorted((run_report_by_hand(d, t) for d, t in rows), key=repr)


def test_runs_and_collapsed_texts(spark, odd_docs, empty_docs):
    tail = {(r.doc_id, r.start, r.length, r.period) for r in word_runs.runs(odd_docs).collect() if r.doc_id == 9}
    assert tail == {(9, 0, 60, 1)}
    texts = {r.doc_id: (r.text, r.n_runs) for r in word_runs.collapsed(odd_docs).collect()}
    assert texts[9] == ("tail", 1) and texts[1] == ("", 0) and texts[4] == ("one", 0)
    for f in (word_runs.runs, word_runs.collapsed, word_runs.report):
        assert f(empty_docs).collect() == []

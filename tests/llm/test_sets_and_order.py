"""N-gram join, shards and mixing against brute force."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from text_brute_force import linked_by_hand, shingle_sets

from gustline.llm import mixing, ngram_join, sharding
from gustline.llm.graph import components


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for length in (3, 4, 7, 12, 15, 20, 25, 40, 90, 300):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, length // 25), max(1, length // 12)])):
                at = rng.randrange(len(copy))
                move = rng.random()
                if move < 0.5:
                    copy[at] = rng.choice(vocabulary)
                elif move < 0.75:
                    copy.insert(rng.choice([0, len(copy)]), rng.choice(vocabulary))
                elif len(copy) > 1:
                    copy.pop(rng.choice([0, len(copy) - 1]))
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 3, 9, 10), (2, 5, 8, 10), (3, 1, 6, 10)])
def test_linked_documents(spark, seed, k, num, den):
    docs = near_copies(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.linked_documents(frame, k, num, den).select("doc_id", "n_shingles", "component_id")
    want = linked_by_hand(docs, k, num, den)
    assert rows(got) == want
    assert len({w[2] for w in want}) < len(want)


def test_keys_are_shared_by_all_linked_sets():
    """Any two linked sets of one size range share a key, also with parts left empty."""
    rng = np.random.default_rng(4)
    for num, den in ((9, 10), (8, 10), (6, 10)):
        plan = ngram_join.Plan(num, den, 3)
        for n in [*range(1, 60), 100, 250]:
            for _ in range(6):
                x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                m = int(rng.integers(plan.least(n), plan.most(n) + 1))
                shared = plan.overlap(n, m)
                y = np.unique(np.concatenate([rng.permutation(x)[:shared], rng.integers(0, 1 << 63, m - shared).astype(np.uint64)]))
                if set(x) != set(y):
                    assert set(ngram_join.signatures(x, plan)) & set(ngram_join.signatures(y, plan)), (n, m)


def test_linked_odd_rows(odd_docs, empty_docs, plain_rows):
    docs = plain_rows(odd_docs)
    got = rows(ngram_join.report(odd_docs))
    # rows of one doc_id are one document: both texts of 7 belong to the component of 6
    want = linked_by_hand(docs, 3, 9, 10)
    want = sorted(((d, n, 6 if d == 7 else c) for d, n, c in want), key=repr)
    assert got == want
    assert ngram_join.report(empty_docs).count() == 0
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 9, 10, 11] and ids.count(None) == 2


def test_near_copies_of_every_text_of_an_id(spark):
    """Two texts share the id 7; near copies of either link to it, also where one is named by it alone."""
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(300)]) for _ in range(120)) for _ in range(3))
    docs = [(7, a), (7, b), (8, b + " more"), (9, a + " more"), (5, c), (6, c + " end"), (10, c), (9, a + " more"), (11, a)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in ngram_join.report(frame).collect()}
    assert found == {(7, 7), (8, 7), (9, 7), (11, 7), (5, 5), (6, 5), (10, 5)}


def test_packed_keys_find_all_that_are_met_again():
    rng = np.random.default_rng(9)
    keys = rng.integers(-1 << 63, 1 << 63, 5000)
    parts = [keys[:3000], keys[2500:], keys[:10], keys[:10], np.r_[keys[4990:], keys[4990:]]]
    for bits in (1, 6):
        batches = []
        for some in parts:
            packed = ngram_join.PackedKeys(bits)
            packed.add(some)
            batches.append(packed.flush())
        table = pa.Table.from_batches(batches).combine_chunks()
        met = set()
        for bucket in set(table.column("bucket").to_pylist()):
            met |= set(ngram_join._met(table.filter(pc.equal(table.column("bucket"), bucket))).column("met").to_pylist())
        assert met == set(packed.short(np.r_[keys[2500:3000], keys[:10], keys[4990:]]).view(np.int64).tolist())
        assert ngram_join.PackedKeys(bits).flush() is None


def test_key_filter_denies_no_met_key(spark):
    rng = np.random.default_rng(10)
    keys = rng.integers(-1 << 63, 1 << 63, 6000)
    short = ngram_join.PackedKeys(5).short(keys)
    met = spark.createDataFrame([(int(x),) for x in short[:3000].view(np.int64)], "met long")
    found = ngram_join.key_filter(met, 3000, 5).holds(keys)
    assert found[:3000].all() and found[3000:].mean() < 0.1


def test_sized_parities_keep_linked_pairs(spark):
    plan, rng = ngram_join.Plan(8, 10, 5), np.random.default_rng(3)
    rows, linked = [], []
    for i in range(60):
        n = int(rng.choice([100, 250, 260, 900, 1100]))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        m = int(rng.integers(plan.least(n), plan.most(n) + 1))
        same = plan.overlap(n, m) if i % 2 else n // 3
        y = np.r_[x[:same], rng.integers(0, 1 << 63, m - same).astype(np.uint64)]
        linked.append(i % 2 == 1)
        rows.append((i, i, n, m, *[bytearray(ngram_join._parities(s, ngram_join._cells(len(s))).tobytes()) for s in (x, y)]))
    frame = spark.createDataFrame(rows, "u long, v long, nu int, nv int, pu binary, pv binary")
    kept = {r.u for r in frame.mapInArrow(ngram_join._may_link(plan), "u long, v long").collect()}
    assert {i for i, yes in enumerate(linked) if yes} <= kept and len(kept) < 40


def test_pairs_that_cannot_link_do_not_leave_the_join(spark):
    plan, rng = ngram_join.Plan(8, 10, 5), np.random.default_rng(5)
    found, linked = [], set()
    for i in range(240):
        n, m = ((395, 395), (500, 530), (530, 500), (240, 270))[i % 4]
        shared = plan.overlap(n, m) if i % 8 < 4 else round(0.7 * min(n, m))
        x, y = (rng.integers(0, 2**63, size, np.uint64) for size in (n, m))
        y[:shared] = x[:shared]
        if i % 8 < 4:
            linked.add(i)
        for v, z in ((2 * i, x), (2 * i + 1, y)):
            small = ngram_join._parities(z, 256).view(np.int64).tolist()
            found.append((v, len(z), *small, bytearray(ngram_join._parities(z, ngram_join._cells(len(z))).tobytes())))
    sets = spark.createDataFrame(found, "v long, n int, s1 long, s2 long, s3 long, s4 long, parity binary")
    sets = sets.withColumn("words", ngram_join._words())
    assert sets.where("size(words) * 8 <> length(parity)").count() == 0
    pairs = sets.alias("a").join(sets.alias("b"), (F.col("a.v") + 1 == F.col("b.v")) & (F.col("a.v") % 2 == 0))
    by_256 = {r.i for r in pairs.where(ngram_join._filter(plan)).select(F.expr("a.v div 2 as i")).collect()}
    kept = {r.i for r in pairs.where(ngram_join._close(plan)).select(F.expr("a.v div 2 as i")).collect()}
    assert linked <= kept <= by_256 and len(kept - linked) < len(by_256 - linked) / 3


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 9), (20, 21), (30, 30), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 3)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    cells = list(product(range(2 ** bits), repeat=dims))
    frame = spark.createDataFrame(cells, ", ".join(f"x{i} int" for i in range(dims)))
    got = frame.select("*", sharding.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits).alias("at")).collect()
    path = [r[:dims] for r in sorted(got, key=lambda r: r["at"])]
    assert [r["at"] for r in sorted(got, key=lambda r: r["at"])] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_shards(small_docs, odd_docs, empty_docs, plain_rows):
    for docs in (small_docs, odd_docs):
        got = sharding.shard_report(docs).collect()
        want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in plain_rows(docs)), key=repr)
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
        slots, sizes = defaultdict(list), defaultdict(int)
        for r in got:
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
        largest = max(r.size for r in got)
        assert all(abs(b - sum(sizes.values()) / 8) <= largest for b in sizes.values())
    assert sharding.shard_report(empty_docs).count() == 0
    whole = sharding.hilbert_shards(odd_docs, keep=list(odd_docs.columns))
    assert whole.count() == odd_docs.count() and len(set(whole.columns)) == len(whole.columns)
    assert set(odd_docs.columns) <= set(whole.columns) and whole.where("slot is null or shard is null").count() == 0


def shares_by_hand(children, budget):
    """Pour into all that are not full, again and again."""
    share = dict.fromkeys(children, 0.0)
    for _ in range(200):
        unfilled = [c for c in children if children[c][1] > 0 and share[c] < children[c][0] - 1e-9]
        left = budget - sum(share.values())
        if not unfilled or left < 1e-9:
            break
        for c in unfilled:
            share[c] = min(children[c][0], share[c] + left * children[c][1] / sum(children[x][1] for x in unfilled))
    return share


@pytest.mark.parametrize("budget", [1.0, 100.0, 480.0, 2000.0])
def test_budget_of_siblings(spark, budget):
    children = {"a": (100.0, 1.0), "b": (30.0, 2.0), "c": (0.0, 1.0), "d": (400.0, 0.5), "e": (60.0, 0.0)}
    frame = spark.createDataFrame([(p, n, c, w, budget) for p in "xy" for n, (c, w) in children.items()],
                                  "p string, n string, capacity double, weight double, given double")
    got = mixing.shared_budget(frame, ["p"], "given", "weight", "capacity").collect()
    want = shares_by_hand(children, budget)
    assert len(got) == 10 and all(abs(r.share - want[r.n]) < 1e-6 for r in got)


def test_mix_of_leaves(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s2", "s2"]))
            for i in range(900)]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, lang string, source string, epoch int")
    frame = frame.drop("epoch").withColumn("leaf", F.lit(1))
    weights = [spark.sql("select * from values ('en', 1D), ('de', 3D) t(lang, weight)"), None]
    tree = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mixed_documents(frame, tree, weights, budget=6000.0, max_epochs=2, default=0.5)
    assert got.columns == [*frame.columns, "epoch"]
    taken = defaultdict(list)
    for r in got.collect():
        taken[(r.lang, r.source)].append(r)
    tokens = defaultdict(int)
    for _, text, lang, source in docs:
        tokens[(lang, source)] += len(text.split())
    languages = {lang: (2.0 * sum(n for k, n in tokens.items() if k[0] == lang), w) for lang, w in (("en", 1.0), ("de", 3.0), (None, 0.5))}
    upper = shares_by_hand(languages, 6000.0)
    for lang, share in upper.items():
        for leaf, budget in shares_by_hand({k: (2.0 * n, float(n)) for k, n in tokens.items() if k[0] == lang}, share).items():
            mine = taken[leaf]
            used = sum(len(r.text.split()) for r in mine)
            assert budget - 30 <= used <= budget + 1e-6
            whole = [r.doc_id for r in mine if r.epoch == 0]
            if budget >= tokens[leaf]:      # a whole epoch, then part of the next
                assert sorted(whole) == sorted(d for d, _, *k in docs if tuple(k) == leaf)
            assert len({(r.doc_id, r.epoch) for r in mine}) == len(mine)


def test_mix_of_odd_rows(spark, odd_docs, empty_docs):
    clashing = odd_docs.withColumns({c: F.lit(1) for c in ("epochs", "left", "end", "leaf", "cuts", "budget", "tokens", "bucket")})
    mixed = mixing.corpus_mix(spark, clashing)
    assert mixed.columns == [*[c for c in clashing.columns if c != "epoch"], "epoch"]
    got = mixed.collect()
    assert {r.text for r in got} <= {r.text for r in odd_docs.collect()}
    assert mixing.corpus_mix(spark, empty_docs).count() == 0
    again = mixing.corpus_mix(spark, clashing).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    kept = mixing.corpus_mix(spark, odd_docs, epoch="_stage_epoch").drop("_stage_epoch")
    assert kept.columns == odd_docs.columns


def tree_by_hand(leaves, weights, depth, budget, path=()):
    """Budgets of the leaves under ``path``: usable capacity from below, then water poured from above."""
    def usable(p):
        if len(p) == depth:
            return leaves[p]
        below = {q[:len(p) + 1] for q in leaves if q[:len(p)] == p}
        return sum(usable(q) for q in below if weights[q] > 0)

    if len(path) == depth:
        return {path: budget}
    children = {q[:len(path) + 1] for q in leaves if q[:len(path)] == path}
    out = {}
    for child, share in shares_by_hand({c: (usable(c), weights[c]) for c in children}, budget).items():
        out |= tree_by_hand(leaves, weights, depth, share, child)
    return out


@pytest.mark.parametrize("budget", [300.0, 1000.0, 5000.0])
def test_budget_of_a_tree_with_zero_weights(spark, budget):
    """What lies below a weight of zero gives nothing, and its share goes to siblings, then to the rest of the tree."""
    named = [{"A": 1.0, "B": 1.0, "C": 0.5}, {"x": 0.0, "y": 1.0, "z": 2.0}, {"p": 1.0, "q": 0.0, "r": 3.0}]
    rng = random.Random(4)
    leaves = {(a, b, c): float(rng.choice([0, 10, 200, 700])) for a in named[0] for b in named[1] for c in named[2]}
    leaves |= {("A", "y", "r"): 10.0, ("A", "x", "p"): 1000.0, ("A", "z", "q"): 5000.0}
    weights = {p[:k + 1]: named[k][p[k]] for p in leaves for k in range(3)}
    tables = [spark.createDataFrame(list(w.items()), f"l{k} string, weight double") for k, w in enumerate(named)]
    frame = spark.createDataFrame([(*p, int(n)) for p, n in leaves.items()], "l0 string, l1 string, l2 string, tokens long")
    got = {(r.l0, r.l1, r.l2): r.budget for r in mixing.leaf_budgets(frame, ["l0", "l1", "l2"], tables, budget, 1).collect()}
    want = tree_by_hand(leaves, weights, 3, budget)
    assert got == pytest.approx(want, abs=1e-6)
    usable = sum(n for p, n in leaves.items() if all(weights[p[:k + 1]] > 0 for k in range(3)))
    assert sum(got.values()) == pytest.approx(min(budget, usable))

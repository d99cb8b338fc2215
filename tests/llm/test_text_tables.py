"""Decontamination, URL rules, quality rules and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gustline.llm import decontamination, quality, repeats, url_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def contamination_by_hand(docs, items):
    phrases = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            phrases.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lowered(text)), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[tuple(w[i:i + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_contamination(spark, small_docs, odd_docs, plain_rows):
    same = plain_rows(odd_docs.where("doc_id = 6"))[0][1]
    items = [(1, " ".join(same.split()[20:45])), (2, "ONE"), (3, ""), (4, None), (None, "Another Text"), (5, "tail tail"),
             (5, "nul vt"), (6, "ÀÉÎ straße"), (7, "àéî straße"), (8, "absent words here")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for docs in (odd_docs, small_docs):
        got = decontamination.report(docs, frame).collect()
        assert in_order(got) == in_order(contamination_by_hand(plain_rows(docs), items))
    kept = decontamination.clean_documents(odd_docs, frame)
    assert kept.columns == odd_docs.columns
    clean = [(d, t) for (d, t), r in zip(plain_rows(odd_docs), contamination_by_hand(plain_rows(odd_docs), items), strict=True)
             if not r[2]]
    assert in_order(plain_rows(kept)) == in_order(clean)


def test_contamination_of_nothing(spark, odd_docs, empty_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(odd_docs, none).where("contaminated or n_items > 0").count() == 0
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontamination.report(empty_docs, some).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green blue"), (2, "red green blue"), (3, "blue green"), (4, "red " + "x " * 30 + "green blue")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    distinct, _ = decontamination.phrases(items)
    index = decontamination.build_index(docs)
    terms = decontamination.phrase_terms(distinct, index)
    near = decontamination.proximity_matches(docs, distinct, index, terms, 3)
    assert {r.doc_id for r in near.collect()} == {1, 2}
    exact = decontamination.phrase_starts(index, terms, rarest=3)
    assert {r.doc_id for r in exact.collect()} == {2}


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity_of_every_term(spark, slop):
    rng = random.Random(slop)
    phrase = "a b c d a e f g h i".split()
    rows = [(None, None), (None, " ".join(phrase)), (0, ""), (1, " ".join(phrase[:-1]) + " z"), (2, "z " + " ".join(phrase[::-1])), (3, " ".join(phrase[2:]))]
    for k in range(4, 40):
        w = phrase.copy()
        for _ in range(rng.randrange(3)):
            i, j = rng.randrange(10), rng.randrange(10)
            w[i], w[j] = w[j], w[i]
        rows.append((k, " ".join(["z"] * rng.randrange(4) + w + w[:rng.randrange(10)])))
    rows += rows[-3:]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distinct, _ = decontamination.phrases(spark.createDataFrame([(1, " ".join(phrase)), (2, "z a b")], "item_id long, text string"))
    index = decontamination.build_index(docs, distinct.select(F.explode(F.split("phrase", " ")).alias("term")))
    terms = decontamination.phrase_terms(distinct, index)
    leads = {r.phrase_id: (r.term, r.offset) for r in terms.where("rank = 1").collect()}
    want = set()
    for p, text in {r.phrase_id: r.phrase for r in distinct.collect()}.items():
        lead, at = leads[p]
        for doc, t in set(rows):
            w = (t or "").split()
            for start in [i - at for i, word in enumerate(w) if word == lead]:
                if all(term in w[max(0, start + o - slop):max(0, start + o + slop + 1)] for o, term in enumerate(text.split())):
                    want.add((p, doc, start))
    got = [(r.phrase_id, r.doc_id, r.start) for r in decontamination.proximity_matches(docs, distinct, index, terms, slop).collect()]
    assert in_order(got) == in_order(want) and len(want) > 3


def verdict_by_hand(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lowered(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
    fit = [(len(h) + len(p), h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("seed", [1, 2])
def test_url_rules(spark, seed):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "com", "net", "x-y"])
    rules = {(".".join(label() for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 4)))):
             rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = ["http://" + ".".join(label() for _ in range(rng.randint(1, 4))).upper() + rng.choice(["", "/", "/a", "/ab/b?x=/", "/b/a#t", "?q"])
            for _ in range(800)] + [None, "", "no-scheme", "http://", "x://com/"] + ["http://com/a"] * 300
    pages = spark.createDataFrame([(i if i % 50 else None, u, "k", "r") for i, u in enumerate(urls)],
                                  "page_id long, url string, key string, range string")
    pages = pages.union(pages.where("page_id is null"))
    got = url_rules.judged_urls(pages, url_rules.rule_table(spark, rules)).collect()
    ids = [(i if i % 50 else None, u) for i, u in enumerate(urls)]
    want = [(i, *verdict_by_hand(u, rules)) for i, u in ids + [x for x in ids if x[0] is None]]
    # of equally long rules any may be named; they are told apart by host and path here
    assert in_order(r[:3] for r in got) == in_order(w[:3] for w in want)
    assert in_order((r[0], r[1], r[2], len(r[3] or "")) for r in got) == in_order((w[0], w[1], w[2], len(w[3] or "")) for w in want)


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judged_urls(pages, url_rules.rule_table(spark, [])).collect()] == [
        (1, "a.com", "/", None, "allow")]
    assert url_rules.judged_urls(pages.where("false"), url_rules.rule_table(spark)).count() == 0


def measures_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {p for i, x in enumerate(windows) if count[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_measures(small_docs, odd_docs, plain_rows):
    for docs in (odd_docs, small_docs):
        got = quality.report(docs).collect()
        assert in_order(r[:7] for r in got) == in_order((d, *measures_by_hand(t)) for d, t in plain_rows(docs))
        assert not [r for r in got if r.base_failed and r.kept]


def test_order_of_rules_does_not_matter(odd_docs):
    whole = odd_docs.withColumn("q_text", F.col("text"))
    one = quality.cascade(whole, quality.RULES).where("q_rejected_by is null").count()
    other = quality.cascade(whole, quality.RULES[::-1]).where("q_rejected_by is null").count()
    assert one == other == quality.kept_documents(odd_docs).count()
    assert quality.kept_documents(odd_docs).columns == odd_docs.columns


def test_quality_of_clashing_columns(odd_docs):
    names = ["q_words", "q_text", "q_row", "q_rejected_by", "rejected_by", "q_n_words", "row"]
    clashing = odd_docs.withColumns({c: F.lit("mine") for c in names})
    kept = quality.kept_documents(clashing)
    assert kept.columns == clashing.columns and kept.where("q_words = 'mine' and rejected_by = 'mine'").count() == kept.count()
    assert sorted(map(repr, kept.select(odd_docs.columns).collect())) == sorted(map(repr, quality.kept_documents(odd_docs).collect()))
    assert quality.judged(clashing).where("rejected_by is null").count() == kept.count()


def test_order_of_rules_follows_cost_and_what_is_left(spark, monkeypatch):
    """A rule that rejects nothing new comes last, a cheap one that rejects as much as a dear one first."""
    rows = spark.createDataFrame([("a b",)] * 40 + [(" ".join(f"w{i}" for i in range(60)),)] * 60, "text string")
    monkeypatch.setattr(quality, "_measure_costs", lambda sample, names: {n: 5.0 if n == "n_repeat_words" else 0.1 for n in names})
    found = [r.name for r in quality.ordered_rules(rows, quality.RULES, sample_rows=1000)]
    assert found[0] == "few_words" and found[-1] == "repeated_windows"
    # each measure behind the first rule is left out for the rows that it rejects
    df = quality.cascade(rows.withColumn("q_text", F.col("text")), [quality.RULES[0], quality.RULES[1]])
    assert df.where("q_n_words < 20 and q_n_repeat_words is not null").count() == 0 and df.where("q_n_repeat_words is not null").count() == 60


def test_quality_of_nothing(empty_docs):
    assert quality.report(empty_docs).count() == 0


def spans_by_hand(docs, length, keep_first=False):
    places = {}
    for k, (_, text) in enumerate(docs):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            places.setdefault(data[i:i + length], []).append((k, i))
    out = []
    for k, (doc, text) in enumerate(docs):
        data = (text or "").encode()
        gone = set()
        for i in range(len(data) - length + 1):
            at = places[data[i:i + length]]
            if len(at) > 1 and (not keep_first or at[0] != (k, i)):
                gone |= set(range(i, i + length))
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc, len(data), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings(spark, small_docs, plain_rows):
    docs = small_docs.where("length(text) < 6000")
    assert in_order(repeats.report(docs).collect()) == in_order(spans_by_hand(plain_rows(docs), 400))


@pytest.mark.parametrize("widths", [(1,), (7, 3, 1), repeats.WIDTHS])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeated_short_strings(spark, monkeypatch, keep_first, widths):
    monkeypatch.setattr(repeats, "WIDTHS", widths)
    rng = random.Random(5)
    base = "".join(rng.choice("abcé") for _ in range(300))
    texts = [base, base, base[:120] + "x" + base[120:], base[50:200], "a" * 90, "ab" * 40, None, "", base[100:140],
             "q" * 10 + base[10:90] + "w" + base[150:260], "a" * 41, "zz" + "a" * 60]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, "k", "lo") for d, t in rows], "doc_id long, text string, key string, lo string")
    got = repeats.without_repeats(docs, 40, keep_first).collect()
    assert in_order((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == in_order(
        spans_by_hand(rows, 40, keep_first))


def test_anchors_of_short_periods_are_few():
    text = pa.array(["a" * 20_000, "abc" * 7_000, "", "x" * 400], pa.large_string())
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array([5, 6, 7, 8]), text], names=["doc_id", "text_key", "text"])
    rows = pa.Table.from_batches(repeats._anchor_rows(400, 320)([batch])).to_pylist()
    assert len(rows) < 12 and [r["n"] for r in rows if r["doc_id"] == 1] == [20_000 - 399]
    assert {(r["doc_id"], max(q["end"] for q in rows if q["doc_id"] == r["doc_id"])) for r in rows} == {(1, 19_600), (2, 20_600), (4, 0)}


def test_repeats_of_many_near_copies(spark):
    """Thousands of classes of one key: copies that differ close to a common passage of about the length, and equal rows without an id."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))     # noqa: E731
    common = word(60)
    rows = [(k, word(rng.randrange(30)) + common[rng.randrange(25):60 - rng.randrange(25)] + word(30)) for k in range(300)]
    rows += [(None, word(20) + common)] * 3 + [(k, "x" * k + common) for k in range(300, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep_first in (False, True):
        got = repeats.without_repeats(docs, 40, keep_first).collect()
        seen = sorted(set(rows), key=lambda r: (r[0] is not None, r[0])) if keep_first else rows     # equal rows count as one in this order
        assert in_order({(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}) == in_order(
            set(spans_by_hand(seen, 40, keep_first)))


def test_repeated_strings_of_odd_rows(odd_docs, empty_docs, plain_rows):
    rows = [r for r in plain_rows(odd_docs) if len(r[1] or "") < 10_000]
    docs = odd_docs.where("text is null or length(text) < 10000")
    assert in_order(repeats.report(docs).collect()) == in_order(spans_by_hand(rows, 400))
    assert repeats.report(odd_docs).count() == odd_docs.count()
    assert repeats.report(empty_docs).count() == 0

"""Toxicity, token files, main text and the pipeline."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from text_brute_force import linked_by_hand

import corpus_pipeline
from gustline.llm import catalog, decontamination, main_text, quality, token_files, toxicity


def toxic_fixture(spark, n=900):
    rng = random.Random(2)
    plain = [f"{a}{b}{c}" for a in "bdglmnrst" for b in "aeiou" for c in ("n", "r", "st", "l", "nd")]
    bad = ["idiot", "moron", "grobblak", "grobblent", "grobbliss", "scum"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_of_held_out_rows(spark):
    docs, labels = toxic_fixture(spark)
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[i]) for i, r in got.items() if r.held_out]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    wins = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert wins > 0.95 and all(0 <= s <= 1 for s, _ in held)
    right = np.mean([(s >= 0.5) == bool(y) for s, y in held])
    assert right > 0.93


def test_held_out_labels_are_not_read(spark):
    docs, labels = toxic_fixture(spark, 300)
    changed = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - toxic, toxic) as toxic")
    a = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.scored(docs, changed).collect()}
    assert a == b


def test_toxicity_of_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(empty_docs, labels).count() == 0
    _, labels = toxic_fixture(spark, 300)
    docs, _ = toxic_fixture(spark, 300)
    mixed = docs.union(odd_docs.select("doc_id", "text").where("doc_id is null or text is null or text = ''"))
    assert toxicity.scored(mixed, labels).count() == mixed.count()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(catalog.tokenizer_path())


def tokens_by_hand(tokenizer, docs):
    out, start = [], 0
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(small_docs, plain_rows, tokenizer):
    files = token_files.write_token_files(small_docs, catalog.tokenizer_path(), length=128)
    got = sorted(map(tuple, token_files.read_documents(files).collect()))
    assert got == tokens_by_hand(tokenizer, sorted(plain_rows(small_docs)))
    parts = sorted({r.part for r in files.index.select("part").collect()})
    last = {r.part: r.position + r.n_tokens for r in files.index.orderBy("position").collect()}
    for part in parts[:2]:
        reader = token_files.SequenceReader(files.folder, part)
        stream = reader.ids(0, last[part])
        for k in range(-(-last[part] // 128)):
            ids, mask = reader.sequence(k)
            assert len(ids) == 128 and list(ids[mask]) == list(stream[k * 128:(k + 1) * 128])
        reader.close()


def test_tokens_of_odd_rows(odd_docs, empty_docs, plain_rows, tokenizer):
    got = token_files.report(odd_docs, catalog.tokenizer_path()).collect()
    want = tokens_by_hand(tokenizer, plain_rows(odd_docs))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(
        ((d, n, c) for d, _, n, c in want), key=repr)
    places = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert token_files.report(empty_docs, catalog.tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a b", "a b ", "a\n b", "a \nb", "it's you're  'll", "x  y z", "<|endoftext|> a <|endoftext|>",
                                  "数据 处理 😀 ok", "tab\tsep a\x1c b c\x85 d", "", " ", "   "])
def test_encoder_equals_the_library(tokenizer, text):
    encode = token_files.Encoder(open(catalog.tokenizer_path()).read(), "<u2")
    for texts in ([text], [text, "plain words here", text]):
        for end in ([], [7]):
            ids, sizes = encode(pa.array(texts), np.array(end, "<u2").tobytes())
            want = [tokenizer.encode(t, add_special_tokens=False).ids + end for t in texts]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_encoder_of_any_text(tokenizer, monkeypatch):
    rng = random.Random(11)
    signs = ["a", "the", "Word", "é", "ß", "数", "½", "²", "3", "'", "'s", ".", "###", "$", "_", "\n", "\t", " ", "  ", "\x1c", "\x85", "\u00a0",
             "\u0301", "😀", "<|endoftext|>", "-", "ʼ", "\u2028"]
    weights = [6] * 17 + [30] + [1] * (len(signs) - 18)
    monkeypatch.setattr(token_files, "REMEMBERED", 50)     # generations change often
    encode = token_files.Encoder(open(catalog.tokenizer_path()).read(), "<u2")
    for _ in range(60):
        texts = ["".join(rng.choices(signs, weights, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 30))]
        ids, sizes = encode(pa.array(texts))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_slices_of_long_texts():
    assert list(token_files.slices(pa.array(["aa", "b", "c" * 9, "", "dd", "e"]), 3)) == [(0, 2), (2, 3), (3, 6)]
    assert list(token_files.slices(pa.array([], pa.string()))) == []


ARTICLE = "First words of the article, quite long. They go on; and on, with more to say about it.", "Second part: also long, and it ends."
PAGES = {
    "semantic": "<body><header><p>Site</p></header><nav><a>Home</a></nav><article><h1>Title</h1><p>{0}<p>{1}</article><footer>me</footer>",
    "classes": "<div class='top-menu'><ul><li><a href=x>A<li><a href=y>B</ul></div><div id=content><h2>Title</h2><p>{0}</p><p>{1}</p></div>"
               "<div class='sidebar'><p>Other things to read, now, here.</p></div><div class='comments'><p>I like it, a lot, really. Me too!</p></div>",
    "notice": "<div class='cookie-notice'>We use cookies, and so on.</div><main><h1>Title</h1><div>{0}</div><div>{1}</div></main><form>Name <input></form>",
    "raw": "<script>var a = '<p>no</p>';</script><style>p{{}}</style><article><h1>Title</h1><!-- <p>no</p> --><p>{0}</p><aside>ad</aside><p>{1}</p></article>",
}


@pytest.mark.parametrize("kind", PAGES)
def test_main_text(kind):
    assert main_text.main_text(PAGES[kind].format(*ARTICLE)) == "\n\n".join(["Title", *ARTICLE])


LONG = " ".join([*ARTICLE] * 8)
NESTED = {      # the text of all, with {0} long and {1} short
    "lead": "<article><h1>Title</h1><p>{1}</p><div class=body><p>{0}</p><p>{0}</p></div></article>",
    "lead in a wrapper": "<div id=page><h1>Title</h1><p>{1}</p><div class=body><p>{0}</p><p>{0}</p></div></div>",
    "title alone": "<main><h1>Title</h1><div class=by>Me</div><div><div class=body><p>{0}</p><p>{0}</p></div></div></main>",
    "sections": "<article><section><h2>One</h2><p>{0}</p><p>{0}</p></section><section><h2>Two</h2><p>{1}</p></section></article>",
    "sections alone": "<div id=page><div class=a><p>{0}</p><p>{0}</p></div><div class=b><p>{1}</p></div></div>",
    "no wrapper": "<div class=links><a href=x>Out</a> <a href=y>Out</a></div><section><p>{0}</p><p>{0}</p></section>"
                  "<ul><li><a href=z>Two</a></ul><section><p>{1}</p></section><div class=links><a href=x>Out</a></div>",
}


@pytest.mark.parametrize("kind", NESTED)
def test_main_text_holds_every_part(kind):
    body = NESTED[kind].format(LONG, ARTICLE[1])
    got = main_text.main_text(f"<body><nav><a>Home</a></nav><div class=menu>Other</div>{body}<footer>me</footer>")
    want = [p for p in re.sub(r"<[^>]*>", "\n", body).split("\n") if p.strip() and p.strip() != "Out"]
    assert got == "\n\n".join(want)


WRAPPERS = ["article class='post comments-open'", "div class='content has-sidebar'", "div id=content class='no-sidebar'",
            "section class='social-policy'", "article class='post related-news'", "div class='share-prices'", "div id=notice-board"]


@pytest.mark.parametrize("inner", ["", "<div class='sidebar'><p>More to read, now, here.</p></div><div class=comments><p>I like it, a lot. Me too!</p></div>"])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_main_text_of_wrappers_named_like_furniture(wrapper, inner):
    tag, text = wrapper.split()[0], "<h1>Title</h1><p>{}</p><p>{}</p>".format(*ARTICLE)
    for around in ("{}", "<div id=page class='with-widgets'>{}</div>"):
        page = around.format(f"<div class=menu>Other</div><{wrapper}>{text}{inner}</{tag}><footer>me</footer>")
        assert main_text.main_text(f"<body>{page}</body>") == "\n\n".join(["Title", *ARTICLE])


def test_main_text_leaves_out_parts_named_like_furniture():
    many = "".join(f"<article class=comment><p>{p} {i}</p></article>" for i in range(9) for p in ARTICLE)
    for tag in ("article", "main", "div"):
        text = "<{0}><h1>Title</h1><p>{1}</p><p>{2}</p></{0}>".format(tag, *ARTICLE)
        for part in (f"<div class=comments>{many}</div>", f"<div class=related><p>{ARTICLE[0]}</p></div>", "<div class=ad>An advert.</div>"):
            assert main_text.main_text(text + part) == main_text.main_text(part + text) == "\n\n".join(["Title", *ARTICLE])
    advert = f"<div class=ad>{ARTICLE[0]}</div>"
    assert main_text.main_text(f"{advert}<article><h1>Hi</h1><p>Short.</p></article>") == "Hi\n\nShort."
    assert main_text.main_text(f"{advert}<div><h1>Hi</h1><p>Short one, but here.</p></div>") == "Hi\n\nShort one, but here."
    assert main_text.main_text("<div class=social-policy>One, two, three.</div><div class=share-prices>Four.</div>") == "One, two, three.\n\nFour."


WHOLE_TEXT = {     # pages of which only "Site", "Home" and "me" go; {0} and {1} are the article
    "page-wide form": "<form id=aspnetForm><header><h2>Site</h2></header><nav>Home</nav><div id=c><h1>Title</h1><p>{0}</p><p>{1}</p></div></form>",
    "form around an article": "<form><nav>Home</nav><article><h1>Title</h1><p>{0}</p><p>{1}</p></article></form>",
    "header of a post": "<nav>Home</nav><div class=post><header><h1>Title</h1></header><div class=entry><p>{0}</p><p>{1}</p></div></div>",
    "header beside paragraphs": "<header>Site</header><div class=post><header><h1>Title</h1></header><p>{0}</p><p>{1}</p><footer>me</footer></div>",
    "masthead": "<div id=page><header><h1>Site</h1></header><nav>Home</nav><div id=c><h2>Title</h2><p>{0}</p><p>{1}</p></div><footer>me</footer></div>",
    "masthead beside a title": "<div id=page><header><h1>Site</h1></header><div id=c><h1>Title</h1><p>{0}</p><p>{1}</p></div></div>",
    "engines": "<article><h1>Title</h1><p>{0}</p><section id=search-engines><p>{1}</p></section></article>",
    "immune": "<article><h1>Title</h1><section class='immune responses'><p>{0}</p></section><p>{1}</p></article>",
    "meeting": "<main><h1>Title</h1><p>{0}</p><div id=notice-of-meeting><p>{1}</p></div></main>",
    "figure": "<article><h1>Title</h1><p>{0}</p><figure class=side><figcaption>{1}</figcaption></figure></article>",
    "object": "<article><h1>Title</h1><object data=x><p>{0}</p><p>{1}</p></article><object></object>",
    "select": "<article><h1>Title</h1><select><p>{0}</p><p>{1}</p></article>",
    "svg": "<article><h1>Title</h1><svg width=1 /><p>{0}</p><svg><text>no</text></svg><p>{1}</p></article>",
    "spans": "<article><h1>Title</h1><p>{0}</p><span class=ad>Home <span>me</span> Site</span><p>{1}</p></article>",
    "adverts": "<article><h1>Title</h1><p>{0}</p><div class=ad-box><p>{1}</p></div><div class=related-posts><p>{1}</p></div><p>{1}</p>"
               "<form><p>{0}</p></form><div class=user-comments><p>{0}</p></div></article>",
}


@pytest.mark.parametrize("kind", WHOLE_TEXT)
def test_main_text_loses_nothing_of_the_article(kind):
    assert main_text.main_text(f"<body>{WHOLE_TEXT[kind]}</body>".format(*ARTICLE)) == "\n\n".join(["Title", *ARTICLE])


def test_main_text_keeps_buttons_and_formulas_of_a_sentence():
    page = ("<article><p>Let <math><mi>x</mi><annotation>no</annotation></math> be a number, and press <button>OK</button> to go on."
            " <button>Share</button></p><p>More of it, here.</p></article>")
    assert main_text.main_text(page) == "Let x be a number, and press OK to go on.\n\nMore of it, here."


HOSTILE = {
    "spans": "<span class=ad>a " * 3000, "articles": "<article class=ad><h1>a. " * 3000, "quotes": "<a '" * 50_000, "mixed quotes": "<a \"x>\" " * 30_000,
    "open quotes": "<p>a <b title=\"x>'" * 15_000, "objects": "<object>a. " * 20_000, "comments": "<!-- a" * 30_000, "less": "<" * 200_000,
    "closes": "<div>" * 18_000 + "</p></li>" * 12_000, "cells": "<tr><div><td>a. " * 12_000, "lists": "<ul><li>a, " * 20_000,
    "headers": "<div><header><h2>a. </h2></header>" * 5_000 + "<p>b.", "forms": "<form><p>a, b. " * 12_000, "menus": "<div class=menu><p>a, b. " * 8_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_main_text_in_linear_time(kind):
    for page in (HOSTILE[kind], HOSTILE[kind] + "<p>End, of it.</p>"):
        began = time.process_time()
        main_text.main_text(page)
        assert time.process_time() - began < 3


def test_main_text_details():
    page = "<article><p>A &amp; B\n\t c&nbsp;d<br>e <b>f</b>g.</p><table><tr><td>1<td>2</table><ul><li>x<li>y</ul></article>"
    assert main_text.main_text(page) == "A & B c d e fg.\n\n1\n\n2\n\nx\n\ny"
    assert [main_text.main_text(p) for p in (None, "", "   ", "<p>", "<nav>a</nav>")] == [""] * 5


def test_main_text_query(spark, small_dir):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>Some text, here.", 2), (3, "v", "", 3), (3, "v", "", 3)],
                                  "page_id long, url string, html string, text int")
    got = sorted(map(tuple, main_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (None, "u", "Some text, here.", 16), (3, "v", "", 0), (3, "v", "", 0)], key=repr)
    assert main_text.extract(pages.where("false")).count() == 0
    real = main_text.extract(spark.read.parquet(f"{small_dir}/pages.parquet"))
    assert real.where("n_chars = 0 or n_chars <> length(text)").count() == 0


def test_pipeline(spark, small_dir, small_docs):
    docs, sizes = small_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, small_dir)
        after = spark.createDataFrame(after.toArrow())
        if name != "sharding":
            assert after.columns == small_docs.columns
        sizes[name] = (docs, after)
        docs = after
    before, after = sizes["quality_rules"]
    bad = {r.doc_id for r in quality.report(before).where("not kept").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = sizes["ngram_join"]
    found = linked_by_hand([(r.doc_id, r.text) for r in before.collect()], 5, 8, 10)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, c in found if d == c)
    before, after = sizes["decontamination"]
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    bad = {r.doc_id for r in decontamination.report(before, items).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = sizes["source_mix"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = sizes["sharding"]
    assert after.count() == before.count() and after.columns[:5] == small_docs.columns
    assert corpus_pipeline.run(spark, small_dir).count() == after.count()

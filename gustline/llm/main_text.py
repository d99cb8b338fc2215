"""The main text of web pages by tag-path ratios.

A page is cut into blocks, the pieces of text between block-level tags, each with the path of tags from the
root. Per path the length of the text outside links and the punctuation are summed over all its blocks and
divided by their number: article paths have long, punctuated blocks, menus and lists of links short bare ones.
The ratios, in page order, are smoothed over neighbouring blocks and fused with the ratio of the
path; paths above a threshold give the seed blocks. The lowest common ancestor of all seeds is the article, or the
<article> or <main> around it, and everything in it is taken in page order, but for what stands in parts that are
furniture by tag, role or class (navigation, footers, forms, adverts, notices, reader comments and the like). A class or
a form alone does not decide: a part named like furniture stays where it is or holds the article or main of the page, or most
of its weight by path ratios; and within an article where its name says something else too ("search-engines") and
its own ratio is that of an article. A header outside <article> and <main> belongs to the article where it holds the first heading
of the page beside the article's text, a masthead beside the navigation does not. A seed counts where the ratio of its own path,
not of its neighbours alone, is above the threshold, or where it is a paragraph, heading or list item that is not mostly links. Where
the ancestor is the whole body, parts of it that are mostly links are left out before the first and behind the last seed.

Time is in proportion to the page (``page_blocks.py``), also for broken quotes and thousands of nested elements.

Defined results: a null, empty or text-free page gives an empty text; a page with nothing but parts named like furniture
gives the text of those that may be the article; markup that is never closed ends where its parent ends; repeated rows
are handled one by one; a null url stays null; other columns are not looked at;
an empty table gives an empty result. Nothing is dropped for its length.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.page_blocks import CLASS, HEADER, Block, Element, Page, read_page

RESULT = "page_id long, url string, text string, n_chars long"

REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|discussion|disqus|repl(?:y|ies)|responses?|respond)(?:$|[\s_-])", re.I)
#: Words of furniture that articles are named by too, and words that say nothing of what a part holds.
AMBIGUOUS = frozenset(
    "notice notices alert side aside menu menus search searches reply replies response responses respond discussion share sharing "
    "social related banner banners copyright disclaimer skip navigation recommendation recommendations".split())
STRUCTURE = frozenset(
    "area bar block body bottom box button buttons card center column container content danger entry extra footer form group head header "
    "headline holder icon icons id info inner item items js left line link links list main media message messages more news outer page "
    "panel post posts primary reader result results right row secondary section site slot small success text thread title top unit user "
    "users warning wrap wrapper".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟]")
SHARE = 0.3     # of the mean ratio of the page: blocks above it are seeds
HOLDS = 0.8     # of the seeds' text: in the part of a page without wrapper of which nothing is left out
RIVAL = 0.25    # of the weight of a part named like furniture: more than that outside is the article, and the part is not
RIVAL_PLAIN = 0.02      # the same where the name says nothing else, and for reader comments, often far longer than the article
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption".split())
WHOLE = frozenset(["", "html", "body"])


def _ratios(blocks: list[Block]) -> tuple[list[float], dict[int, int]]:
    """Path ratio of every block, and the length outside links per path."""
    length, marks, number = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        path = b.element.path
        length[path] += max(0, len(b.text) - b.linked)
        marks[path] += len(PUNCTUATION.findall(b.text))
        number[path] += 1
    return [length[p] / number[p] * (1 + marks[p] / number[p]) for p in (b.element.path for b in blocks)], length


def _words(named: str) -> list[str]:
    return [w for w in re.split(r"[\s_-]+", named.lower()) if w]


def _plain(named: str) -> bool:
    """Whether class and id say nothing but furniture, or comments or a header."""
    return bool(REMARKS.search(named) or HEADER.search(named)) or all(map(CLASS.search, re.split(r"[\s_-]+", named.strip())))


def _says_more(named: str) -> bool:
    """Whether the words of furniture in a name have other meanings, and there is a word of substance."""
    words = _words(named)
    return (all(w in AMBIGUOUS for w in words if CLASS.search(w))
            and any(len(w) > 2 and not w.isdigit() and w not in STRUCTURE and w not in AMBIGUOUS for w in words))


def _sums(values: list) -> list:
    return list(accumulate(values, initial=0))


def _content(page: Page) -> list[int]:
    """Numbers of the blocks that are not in a part named like furniture, unless that part holds the article.

    Parts are judged from the outermost in; what is decided of a part counts for those inside it.
    """
    blocks = page.blocks
    named = [e for e in page.tree if e.named and e.stop > e.first and not e.furniture and not e.masthead]
    if not named:
        return list(range(len(blocks)))
    ratio, _ = _ratios(blocks)
    weights = _sums(ratio)
    total, mean = weights[-1], weights[-1] / len(blocks)
    in_articles, in_headings = _sums([b.element.articles > 0 for b in blocks]), _sums([b.element.headed for b in blocks])
    linked, sizes = _sums([b.linked for b in blocks]), _sums([len(b.text) for b in blocks])
    prose = _sums([b.element.tag in PROSE and r >= SHARE * mean and len(PUNCTUATION.findall(b.text)) > 0
                   for b, r in zip(blocks, ratio, strict=True)])
    own = defaultdict(list)     # blocks by the innermost named part around them
    for i, b in enumerate(blocks):
        own[b.element.part].append(i)
    kept: set[Element | None] = {None}
    rest, outside, headed = 0.0, 0, False
    inner, seen, seen_to = -1, set(), len(page.tree)      # articles with a block outside: innermost, all, smallest end

    def release(part: Element | None) -> None:
        """The blocks of a part that are in no other part stand outside from now on."""
        nonlocal rest, outside, headed, inner, seen_to
        for i in own[part]:
            rest, outside = rest + ratio[i], outside + 1
            e = blocks[i].element
            headed = headed or e.articles > 0 or e.headed
            while e is not None and e.articles and e not in seen:
                seen.add(e)
                if e.tag in ("article", "main"):
                    inner, seen_to = max(inner, e.no), min(seen_to, e.last)
                e = e.parent

    depth: dict[Element, int] = {}
    levels = defaultdict(list)
    for e in named:
        above = e.parent.part
        depth[e] = depth.get(above, 0) + 1
        levels[depth[e]].append(e)
    release(None)
    for level in sorted(levels):
        found = []
        for part in levels[level]:
            if part.parent.part not in kept or inner > part.no or seen_to < part.last:
                continue        # in a part that goes, or the article is elsewhere
            a, z = part.first, part.stop
            weight = weights[z] - weights[a]
            most, article, heading = 2 * weight > total, in_articles[z] > in_articles[a], in_headings[z] > in_headings[a]
            if part.named == "form":
                keep = (not outside or (most and rest <= RIVAL * weight)) and (article or heading or prose[z] > prose[a])
            elif not headed and (part.tag == "article" or (most and heading) or (weight > rest and article)):
                keep = True
            elif part.parent.articles and _says_more(part.named):
                keep = (prose[z] > prose[a] and weight >= SHARE * mean * (z - a)
                        and 2 * (linked[z] - linked[a]) <= sizes[z] - sizes[a])
            elif _plain(part.named):
                keep = most and rest <= RIVAL_PLAIN * weight
            else:
                keep = not outside or (most and rest <= RIVAL * weight)
            if keep:
                found.append(part)
        kept.update(found)
        for part in found:
            release(part)
    return [i for i, b in enumerate(blocks) if b.element.part in kept] or list(range(len(blocks)))


def _common(page: Page, rows: list[int]) -> Element:
    """Lowest common ancestor of blocks."""
    numbers = [page.blocks[i].element.no for i in rows]
    low, high = min(numbers), max(numbers)
    return next(e for e in page.blocks[rows[0]].element.line() if e.no <= low and high <= e.last)


def _links_around(page: Page, alive: list[int], seeds: list[int], sure: list[int], whole: Element) -> set[int]:
    """Blocks of the parts of a page that are mostly links, before the first and behind the last of ``sure``."""
    chosen = set(seeds)
    weight = _sums([len(b.text) if i in chosen else 0 for i, b in enumerate(page.blocks)])
    middle = next(i for i in seeds if 2 * weight[i + 1] >= weight[-1])
    core = next(e for e in page.blocks[middle].element.parent.line() if weight[e.stop] - weight[e.first] >= HOLDS * weight[-1]
                ) if page.blocks[middle].element.parent else whole
    branch: dict[int, Element] = {}     # the child of ``whole`` that an element is or lies in
    for e in page.tree[whole.no:whole.last + 1]:
        branch[e.no] = e if e is whole or e.parent is whole else branch[e.parent.no]
    part, text, links = {}, defaultdict(int), defaultdict(int)
    for i in alive:
        b = page.blocks[i]
        if core.holds(b.element) or not whole.holds(b.element):
            continue
        part[i] = branch[b.element.no]
        text[part[i]] += len(b.text)
        links[part[i]] += b.linked
    return {i for i, e in part.items() if not sure[0] <= i <= sure[-1] and 2 * links[e] > text[e]}


def _titles(page: Page, alive: list[int], article: Element) -> list[Block]:
    """Blocks of headers outside <article> and <main> that belong to the article."""
    if any(page.blocks[i].element.headed for i in alive):
        return []
    around = [e.tag in ("nav", "footer") or e.masthead is e for e in page.tree]
    numbers, navs = _sums(around), _sums([e.tag == "nav" for e in page.tree])
    beside_others = Counter(e.parent for e, other in zip(page.tree, around, strict=True) if other)
    kept = frozenset(alive)
    alive_in = _sums([i in kept for i in range(len(page.blocks))])
    heads = defaultdict(list)
    for b in page.mastheads:
        heads[b.element.masthead].append(b)
    held = []
    for head, mine in heads.items():
        heading = any(b.element.headed or b.element.tag == "h2" for b in mine)
        beside = head.parent
        if (not heading or head.part is not None or beside.tag in WHOLE or beside.tag == "form"
                or 2 * sum(b.linked for b in mine) > sum(len(b.text) for b in mine) or navs[head.last + 1] > navs[head.no]):
            continue
        alone = alive_in[beside.stop] - alive_in[beside.first] == alive_in[article.stop] - alive_in[article.first]
        if not article.holds(beside) and not (beside.holds(article) and alone):
            continue
        outside = numbers[-1] - (numbers[beside.last + 1] - numbers[beside.no])
        if beside_others[beside] == 1 or outside:
            held += mine
    return held


def main_text(html_text: str | None) -> str:
    """Content blocks of a page, joined by an empty line."""
    page = read_page(html_text or "")
    if not page.blocks:
        return ""
    alive = _content(page)
    blocks = [page.blocks[i] for i in alive]
    ratio, length = _ratios(blocks)
    smooth = [sum(ratio[max(0, i - 1):i + 2]) / len(ratio[max(0, i - 1):i + 2]) for i in range(len(ratio))]
    fused = [(r + s) / 2 for r, s in zip(ratio, smooth, strict=True)]
    limit = SHARE * sum(fused) / len(fused)
    seeds = [i for i in range(len(blocks)) if fused[i] >= limit and length[blocks[i].element.path]]
    if not seeds:
        return ""
    linked = [2 * b.linked > len(b.text) for b in blocks]
    sure = [i for i in seeds if ratio[i] >= limit or (blocks[i].element.tag in PROSE and not linked[i])]
    sure = sorted({*(sure or seeds), *(i for i, b in enumerate(blocks) if b.element.tag == "h1" and not linked[i])})
    seeds, sure = [alive[i] for i in seeds], [alive[i] for i in sure]
    article = _common(page, sure)
    if article.parent is not None and all(b.element is article or not article.holds(b.element) for b in blocks):
        article = article.parent
    line = list(article.line())
    for tag in ("main", "article"):
        article = next((e for e in reversed(line) if e.tag == tag), article)
    left_out = _links_around(page, alive, seeds, sure, article) if article.tag in WHOLE else frozenset()
    taken = [page.blocks[i] for i in alive if i not in left_out and article.holds(page.blocks[i].element)]
    titles = _titles(page, alive, article) if page.mastheads else []
    return "\n\n".join(b.text for b in sorted([*taken, *titles], key=lambda b: b.order))


def extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            texts = [main_text(page) for page in some.column("html").to_pylist()]
            yield pa.record_batch([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points for every row of ``pages``."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract_rows, RESULT)

"""Blocks of text of a web page, each in the tree of its elements.

One pass over the page: tags are found by a scan that never looks at a character twice (an unfinished quote ends its tag
at the next ``>``, and quotes count no more behind it), elements carry their path as a number and the range of blocks in them, so what
follows adds up whole parts by prefix sums. Time and memory are in proportion to the page, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Their content is no text, up to the end of the page if they are never closed.
RAW = frozenset("script style noscript template iframe textarea title".split())
#: The same, but if they are not closed within their article or body, the tag alone is left out.
RAW_IF_CLOSED = frozenset("svg select object canvas audio video annotation annotation-xml".split())
CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW | RAW_IF_CLOSED}
PART_END = re.compile(r"</(?:article|main|body)\b", re.I)
OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
FIRST_CLASS = re.compile(r"""\bclass\s*=\s*["']?([^\s"'>]+)""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead tr ul hr".split())
CLOSES = {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
          "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
SCOPES = frozenset("ul ol dl table".split())
FURNITURE = frozenset("nav footer aside button menu dialog head option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = (
    r"ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert|"
    r"sidebar\w*|side|aside|menu\w*|nav|navbar|navigation|breadcrumbs?|masthead|topbar|footer\w*|comments?|"
    r"commentlist|discussion|disqus|repl(?:y|ies)|responses?|respond|share|sharing|social|related|recommend\w*|"
    r"newsletter|subscri\w*|signup|login|search\w*|popup|modal|overlay|widget\w*|toolbar|pagination|pager|skip|"
    r"copyright|disclaimer")
CLASS = re.compile(rf"(?:^|[\s_-])(?:{NAMES})(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
STATE = re.compile(r"(?<![\w-])(?:(?:has|no|with|without)[_-][\w-]+|comments?[_-](?:open|closed|enabled|disabled))(?![\w-])", re.I)
PLACED = re.compile(r"(?<![\w-])(?:side|aside)(?![\w-])", re.I)    # says where a figure or table stands, not what it is
SPACES = re.compile(r"\s+")
SENTENCE_END = re.compile(r"[.!?…。！？]\s*\Z")
INLINE_PARENTS = frozenset("p li dd td h1 h2 h3 h4 h5 h6 blockquote figcaption".split())


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    path: int
    parent: Element | None
    no: int                         # in page order
    first: int                      # of the blocks in it
    furniture: bool = False
    named: str = ""                 # class and id that look like furniture, or "form"
    part: Element | None = None     # the innermost named element, itself included
    masthead: Element | None = None     # the header outside any article that it is or lies in
    articles: int = 0               # articles and mains it is or lies in
    headed: bool = False            # lies in a first heading
    nested: int = 0                 # open inline elements of its tag
    last: int = 0                   # element in it
    stop: int = 0                   # behind the last of its blocks

    def holds(self, other: Element) -> bool:
        return self.no <= other.no <= self.last

    def line(self) -> Iterator[Element]:
        """The element and those around it, innermost first."""
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


@dataclass(eq=False, slots=True)
class Block:
    element: Element
    text: str
    linked: int         # characters in links
    order: int          # in the page


@dataclass
class Page:
    tree: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)       # outside furniture
    mastheads: list[Block] = field(default_factory=list)    # in headers outside any article


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, "", "", "") or ("", "/" or "", tag in lower case, attributes) in page order."""
    at, end, trusted = 0, len(page), True
    closes: dict[str, int] = {}     # next close of a raw tag that was looked up, or end + 1
    part_end = -1
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", "", ""
            return
        if lt > at:
            yield page[at:lt], "", "", ""
        if page.startswith("<!--", lt):
            match = COMMENT_END.search(page, lt + 4)
            at = match.end() if match else end
            continue
        match = OPEN.match(page, lt)
        if not match:
            close = page.find(">", lt) if page[lt + 1:lt + 2] in ("!", "?") else -1
            if close < 0:
                yield "<", "", "", ""
            at = close + 1 or lt + 1
            continue
        closing, tag = match[1], match[2].lower()
        found = TAG_END.match(page, match.end()) if trusted else None
        if found:
            at = found.end()
        else:
            trusted = False
            at = page.find(">", match.end()) + 1
            if not at:
                yield page[lt:], "", "", ""
                return
        attributes = page[match.end():at - 1]
        if not closing and tag in CLOSE and not (tag in RAW_IF_CLOSED and attributes.endswith("/")):
            if closes.get(tag, -1) < at:
                match = CLOSE[tag].search(page, at)
                closes[tag] = match.start() if match else end + 1
            if tag in RAW_IF_CLOSED and part_end < at:
                match = PART_END.search(page, at)
                part_end = match.start() if match else end
            if tag in RAW or closes[tag] < part_end:
                at = page.find(">", closes[tag]) + 1 if closes[tag] <= end else end
            continue
        yield "", closing, tag, attributes


def _furniture(tag: str, attributes: str, parent: Element) -> tuple[bool, str]:
    """Whether an element is furniture by tag, role or style, and its class and id if they say so."""
    if tag in FURNITURE:
        return True, ""
    named = "form" if tag == "form" else ""
    if not attributes.strip():
        return False, named
    names = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "role" and value.lower() in ROLES - {tag} or name == "hidden":
            return True, ""
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            return True, ""
        if name in ("class", "id"):
            names.append(value)
    if tag in ("html", "body", "main"):
        return False, ""
    name = STATE.sub("", " ".join(names))
    if tag in ("figure", "table", "blockquote"):
        name = PLACED.sub("", name)
    if CLASS.search(name) or (HEADER.search(name) and not parent.articles):
        named = name
    return False, named


def read_page(page: str) -> Page:
    """Blocks in page order: those outside furniture, and those in headers that may yet belong to the article."""
    out = Page()
    paths: dict[tuple[int, str], int] = {}
    root = Element("", 0, None, 0, 0)
    out.tree.append(root)
    open_tags: Counter[str] = Counter()
    at, spans, order = root, [], 0
    parts: list[str] = []       # of the block that is being read
    linked, in_link = 0, False

    def end() -> None:
        nonlocal parts, linked, in_link, order
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text and not at.furniture:
                (out.mastheads if at.masthead else out.blocks).append(Block(at, text, linked, order))
                order += 1
        parts, linked, in_link = [], 0, False

    def enter(tag: str, attributes: str, furniture: bool, named: str) -> None:
        nonlocal at
        match = FIRST_CLASS.search(attributes)
        path = paths.setdefault((at.path, f"{tag}.{match[1]}" if match else tag), len(paths) + 1)
        e = Element(tag, path, at, len(out.tree), len(out.blocks), at.furniture or furniture, named)
        e.part = e if named else at.part
        e.articles = at.articles + (tag in ("article", "main"))
        e.masthead = at.masthead or (e if tag == "header" and not at.articles else None)
        e.headed = at.headed or tag == "h1"
        out.tree.append(e)
        open_tags[tag] += 1
        at = e

    def leave(outer: Element) -> None:
        nonlocal at
        while at is not outer:
            at.last, at.stop = len(out.tree) - 1, len(out.blocks)
            open_tags[at.tag] -= 1
            at = at.parent

    for text, closing, tag, attributes in tokens(page):
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        said = "".join(parts[-4:]) if tag == "button" else ""
        aside = tag == "button" and (not open_tags[tag] if closing else
                                     at.tag in INLINE_PARENTS and said.strip() and not SENTENCE_END.search(said))
        if tag not in BLOCK or aside:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                if parts:
                    parts.append(" ")
            elif closing:
                if spans and at is spans[-1] and at.tag == tag:
                    if at.nested:
                        at.nested -= 1
                    else:
                        end()
                        leave(spans.pop().parent)
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                furniture, named = _furniture(tag, attributes, at) if attributes and not aside else (False, "")
                if furniture or named:
                    end()
                    enter(tag, attributes, furniture, named)
                    spans.append(at)
                elif spans and at is spans[-1] and at.tag == tag:
                    at.nested += 1
            continue
        end()
        if closing:
            if open_tags[tag]:
                here = at
                while here.tag != tag:
                    here = here.parent
                leave(here.parent)
            continue
        if tag == "hr":
            continue
        ends = CLOSES.get(tag, frozenset(["p"]))
        left = sum(open_tags[t] for t in ends)
        here, outer = at, None
        while left and here.tag not in SCOPES and (here.tag in ends or tag in CLOSES):
            if here.tag in ends:
                outer, left = here, left - 1
            elif here.tag in BLOCK and here.tag != "p" and tag not in ("tr", "td", "th"):
                break
            here = here.parent
        if outer is not None:
            leave(outer.parent)
        enter(tag, attributes, *_furniture(tag, attributes, at))
    end()
    leave(root)
    root.last, root.stop = len(out.tree) - 1, len(out.blocks)
    return out

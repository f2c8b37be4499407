"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut into blocks at block-level tags. A block has its word count, the
share of its words inside links, the same two of the blocks before and after it,
the words of the page, and what its enclosing elements say with how many words. A decision tree, grown on the blocks of the
labelled pages below, says which blocks are main text.

An element that is named like a menu, a footer, an advert and so on weighs on its
blocks, the less the more its name says besides, and not at all if it turns out to hold the page itself: see
``Page.outside``. Of several articles those that the rest of the page, or another article, dwarfs are teasers. Reading
takes time in proportion to the page's length, however its tags are broken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin a new block, hold no text, or enclose what is not main text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = frozenset("title meta link style script base noscript template".split())
ENDS = {
    "p": ("p",), "li": ("p", "li"), "option": ("p", "option"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"),
    "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"),
}
OUTSIDE_TAGS = frozenset("nav header footer aside form menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th option dt".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words that name a region; those of COMMENTS hold what readers wrote.
COMMENTS = frozenset("comment comments commentlist commentform respond reply replies disqus".split())
#: What follows the text under such a name is what readers wrote; text that the page goes on after is the page's own.
LATE = frozenset("discussion discussions response responses reaction reactions feedback thread threads conversation opinions".split())
REGIONS = COMMENTS | LATE | frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notification "
    "alert newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations pager pagination widget toolbar copyright legal disclaimer".split()
)
#: Words that may name a region by coming first.
FIRST = frozenset("ad ads advert advertisement adsense sponsored cookie cookies gdpr newsletter disqus".split())
#: Words that say where or how a region is, not what it is; and words that make a name tell a state of the page.
PLACES = frozenset("left right top bottom primary secondary main site page inner outer wrap wrapper container box list links link area section block group item items content bar row col column text body".split())
#: Fewer words than these after an element are no more of the main text.
LATE_WORDS = 5
#: An element of fewer words is what any part of its name says.
NAMED_WORDS = 45
STATES = frozenset("has no with without is not hide hidden show js".split())

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"(=?[^\s/>=]*)(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
GAP = re.compile(r"[\s/]*")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
SILENT_ENDS = re.compile(rf"</({'|'.join(sorted(SILENT_TAGS))})(?=[\s/>])", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    mark: int  # number of the innermost element named as a region that encloses it; -1: none
    inside: bool  # within an article or main element
    item: bool  # a list item or table cell
    heading: bool
    article: int  # number of the outermost article around it; -1: none


@dataclass
class Page:
    """Blocks in page order; for each element named as a region the one around it (-1: none), how much its name says, whether it
    holds comments, whether only if nothing follows it, and whether it is within an article or main element."""

    blocks: list[Block] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    comments: list[bool] = field(default_factory=list)
    late: list[bool] = field(default_factory=list)
    within: list[bool] = field(default_factory=list)

    def outside(self) -> list[float]:
        """How much each block's elements say that it is outside main text, 0 to 1.

        Names mislead: a menu that is never closed, a header or a form around everything. So an
        element does not count if it has most of the words in article and main elements and three
        tenths of the page's, or, on a page without such words, most of the page's; words in links are
        left aside. Inside an article or main element one does not count if it has two thirds of all such words. A
        name that says something else too says less the more words it has, from NAMED_WORDS on. One of
        comments always counts, and one that is named like comments among other things if no more of the main text follows it.
        """
        own, core = [0] * len(self.around), [0] * len(self.around)
        whole = main = 0
        for b in self.blocks:
            n = b.words - b.linked
            whole += n
            main += n * b.inside
            if b.mark >= 0:
                own[b.mark] += n
                core[b.mark] += n * b.inside
        for k in range(len(own) - 1, -1, -1):  # an element has a greater number than the one around it
            if self.around[k] >= 0:
                own[self.around[k]] += own[k]
                core[self.around[k]] += core[k]
        last = [-1] * len(self.around)  # the last block of each element
        for i, b in enumerate(self.blocks):
            if b.mark >= 0:
                last[b.mark] = i
        for k in range(len(last) - 1, -1, -1):
            if self.around[k] >= 0:
                last[self.around[k]] = max(last[self.around[k]], last[k])
        after, total = [0] * (len(self.blocks) + 1), 0  # unmarked words from each block on
        for i in range(len(self.blocks) - 1, -1, -1):
            b = self.blocks[i]
            total += (b.words - b.linked) * (b.mark < 0 and (b.inside or not main))
            after[i] = total
        off: list[float] = []
        for k, up in enumerate(self.around):
            page_itself = (3 * core[k] > 2 * main if self.within[k] else 2 * core[k] > main and 10 * own[k] >= 3 * whole) if main else 2 * own[k] > whole
            if self.late[k]:
                says = float(after[last[k] + 1] < LATE_WORDS) if last[k] >= 0 else 0.0
            else:
                plain = self.weight[k] == 1 or own[k] < NAMED_WORDS
                says = 0.0 if page_itself and not self.comments[k] else 1.0 if plain else self.weight[k] * NAMED_WORDS / own[k]
            off.append(max(off[up] if up >= 0 else 0.0, says))
        return [off[b.mark] if b.mark >= 0 else 0.0 for b in self.blocks]


def region(name: str) -> tuple[str, float] | None:
    """The word of REGIONS that a class or id names and how plainly, e.g. ('footer', 1) for 'site-footer' and ('ad', 1/2) for 'ad-free-story'; None for 'has-footer' or 'footer-fixed'."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[0] in STATES:
        return None
    while len(words) > 1 and (words[-1] in PLACES or words[-1].isdigit()):
        words.pop()
    if words[-1] in REGIONS:
        return words[-1], 1.0
    return (words[0], 0.5) if words[0] in FIRST else None


def outside(tag: str, attributes: dict[str, str], within_main: bool) -> tuple[float, bool, bool]:
    """How much an element's tag or attributes say that it is no main text, whether they say that it holds comments, and whether only if nothing follows it."""
    if tag in ("html", "body", "main"):
        return 0.0, False, False
    named = dict(r for k in ("class", "id") if k in attributes for name in attributes[k].split() if (r := region(name))) if attributes else {}
    comments = any(n in COMMENTS for n in named)
    if tag == "article":
        return float(comments), comments, False
    if tag in OUTSIDE_TAGS and not (tag == "header" and within_main):
        return 1.0, comments, False
    if not attributes:
        return 0.0, False, False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return 1.0, comments, False
    if attributes.get("role", "").lower() in OUTSIDE_ROLES:
        return 1.0, comments, False
    if within_main:
        named.pop("header", None)
    return max(named.values(), default=0.0), comments, bool(named) and set(named) <= LATE


class Reader:
    """One pass over a page; ``stack`` has the open elements, and ``open`` their places in it by tag."""

    def __init__(self, page: str):
        self.page, self.out = page, Page()
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, and whether it silences, is marked, is a link
        self.open: dict[str, list[int]] = {}
        self.blocks_open: list[int] = []
        self.barriers: list[int] = []
        self.marks: list[int] = [-1]
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.silent = self.mains = self.links = self.items = self.headings = self.articles = 0
        self.article = -1
        self.last_double, self.last_single = page.rfind('"'), page.rfind("'")
        self.ends: dict[str, int] | None = None

    def end_after(self, tag: str, at: int) -> bool:
        """Whether an end tag of this silent element comes later; all such tags are found once."""
        if self.ends is None:
            self.ends = {m[1].lower(): m.start() for m in SILENT_ENDS.finditer(self.page)}
        return self.ends.get(tag, -1) >= at

    def close_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                anchors = SPACE.sub(" ", "".join(self.linked)).strip()
                words = text.count(" ") + 1
                linked = min(words, anchors.count(" ") + 1) if anchors else 0
                self.out.blocks.append(Block(text, words, linked, self.marks[-1], self.mains > 0, self.items > 0, self.headings > 0, self.article if self.articles else -1))
            self.parts.clear()
            self.linked.clear()

    def push(self, tag: str, attributes: dict[str, str], silent: bool) -> None:
        off, comments, late = outside(tag, attributes, self.mains > 0)
        if off:
            self.out.around.append(self.marks[-1])
            self.out.weight.append(off)
            self.out.comments.append(comments)
            self.out.late.append(late)
            self.out.within.append(self.mains > 0)
            self.marks.append(len(self.out.around) - 1)
        link = tag == "a" and "href" in attributes
        place = len(self.stack)
        self.article += tag == "article" and not self.articles
        self.stack.append((tag, silent, off > 0, link))
        self.open.setdefault(tag, []).append(place)
        if tag in BLOCK_TAGS:
            self.blocks_open.append(place)
        if tag in ("article", "main", "table", "body"):
            self.barriers.append(place)
        self.count(tag, silent, link, 1)

    def count(self, tag: str, silent: bool, link: bool, by: int) -> None:
        self.silent += by * silent
        self.links += by * link
        self.mains += by * (tag in MAIN_TAGS)
        self.articles += by * (tag == "article")
        self.items += by * (tag in ITEMS)
        self.headings += by * (tag in HEADINGS)

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, silent, off, link = self.stack.pop()
            self.open[tag].pop()
            for places in (self.blocks_open, self.barriers):
                if places and places[-1] == len(self.stack):
                    places.pop()
            if off:
                self.marks.pop()
            self.count(tag, silent, link, -1)

    def last(self, tag: str) -> int:
        places = self.open.get(tag)
        return places[-1] if places else -1

    def text(self, chunk: str) -> None:
        if not chunk:
            return
        if self.stack and self.stack[-1][0] == "head" and not chunk.isspace():
            self.pop(len(self.stack) - 1)  # text ends the head
        if not self.silent:
            decoded = html.unescape(chunk)
            self.parts.append(decoded)
            if self.links:
                self.linked += (decoded, " ")

    def attributes(self, at: int, wanted: bool) -> tuple[dict[str, str], int, bool]:
        """Attributes from here to the end of the tag, the place behind it, and whether it closes itself."""
        page, found = self.page, {}
        n, slash = len(page), False
        while True:
            gap = GAP.match(page, at)
            slash = gap.end() > at and page[gap.end() - 1] == "/"
            at = gap.end()
            if at >= n:
                return found, n, slash
            if page[at] == ">":
                return found, at + 1, slash
            m = ATTRIBUTE.match(page, at)
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                if quote == '"' and at < self.last_double or quote == "'" and at < self.last_single:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:  # no quotes, or one that is never closed
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            if wanted:
                found.setdefault(m[1].lower(), value)

    def start(self, tag: str, at: int) -> int:
        attributes, at, closed = self.attributes(at, True)
        if tag in BLOCK_TAGS:
            self.close_block()
        if self.open.get("head") and tag not in HEAD_TAGS and tag != "head":
            self.pop(self.last("head"))  # what cannot be in the head ends it
        foreign = max(self.last("svg"), self.last("math"))
        if foreign >= 0 and tag in BLOCK_TAGS and tag != "title":
            self.pop(foreign)  # so with drawings and formulas
        if tag in VOID_TAGS or closed and tag not in BLOCK_TAGS and (tag not in SILENT_TAGS or tag in ("svg", "math")):
            return at
        if tag == "a" and self.last("a") > (self.blocks_open[-1] if self.blocks_open else -1):
            self.pop(self.last("a"))  # links do not nest
        ends = ENDS.get(tag, ("p",) if tag in BLOCK_TAGS else ())
        while ends and self.blocks_open and any(self.last(t) == self.blocks_open[-1] for t in ends):
            self.pop(self.blocks_open[-1])
        silent = tag in SILENT_TAGS and (tag == "head" or self.end_after(tag, at))
        if tag in RAW_TAGS:
            if silent:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at)
                return self.attributes(end.end(), False)[1]
            return len(self.page) if tag in ("script", "style") else at
        self.push(tag, attributes, silent)
        return at

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.close_block()
        place = self.last(tag)
        barrier = self.barriers[-1] if self.barriers else -1
        if place >= 0 and (place >= barrier or tag in ("html", "body", "main", "article")):
            self.pop(place)

    def read(self) -> Page:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 >= n:
                self.text(page[at:])
                break
            after = page[lt + 1]
            if after.isascii() and after.isalpha():
                self.text(page[at:lt])
                m = TAG_NAME.match(page, lt + 1)
                at = self.start(m[0].lower(), m.end())
            elif after == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha():
                self.text(page[at:lt])
                m = TAG_NAME.match(page, lt + 2)
                at = self.attributes(m.end(), False)[1]
                self.end(m[0].lower())
            elif page.startswith("<!--", lt):
                self.text(page[at:lt])
                end = page.find("-->", lt + 2)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", lt):
                self.text(page[at:lt])
                end = page.find("]]>", lt)
                self.text(html.escape(page[lt + 9 : end if end >= 0 else n]))
                at = end + 3 if end >= 0 else n
            elif after in "!?/":
                self.text(page[at:lt])
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:  # a mere sign
                self.text(page[at : lt + 1])
                at = lt + 1
        self.close_block()
        return self.out


def read(page: str) -> Page:
    return Reader(page).read()


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "items", "heading")
#: An article is a teaser if the largest has more than so many times its words, or the text beside all articles more than twice the largest's.
DWARFED = 4


def teasers(page: Page, plain: list[int]) -> set[int]:
    """Numbers of the articles that are not the page's own, of several; ``plain``: each block's unmarked words that are no links."""
    by: dict[int, int] = {}
    beside = within_main = 0
    for b, n in zip(page.blocks, plain, strict=True):
        if b.article >= 0:
            by[b.article] = by.get(b.article, 0) + n
        else:
            beside += n
            within_main += n * b.inside
    if len(by) < 2:
        return set()
    largest = max(by.values())
    if (within_main or beside) > 2 * largest:
        return set(by)
    return {k for k, n in by.items() if n * DWARFED < largest}


def features(page: Page) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block; blocks beyond the page's ends have no words.

    items: the words, without links, of the list or table row after row that it is in. place: 1 within an article or main element that is
    no teaser, 0 beside one, 0.5 where such elements have less than three tenths of the page's unmarked words that are no links; less
    by as much as its elements say that it is outside.
    """
    off = page.outside()
    plain = [(b.words - b.linked) * (x < 1) for b, x in zip(page.blocks, off, strict=True)]
    less = teasers(page, plain)
    off = [1.0 if b.article in less else x for b, x in zip(page.blocks, off, strict=True)]
    inside = [b.inside and x < 1 for b, x in zip(page.blocks, off, strict=True)]
    plain = [n * (x < 1) for n, x in zip(plain, off, strict=True)]
    core, whole = sum(n for n, x in zip(plain, inside, strict=True) if x), sum(plain)
    beside = 0.0 if any(inside) and 10 * core >= 3 * whole else 0.5
    runs, i = [0] * len(page.blocks), 0
    while i < len(page.blocks):
        j = i
        while j < len(page.blocks) and page.blocks[j].item:
            j += 1
        runs[i:j] = [sum(plain[i:j])] * (j - i)
        i = max(j, i + 1)
    flat = [(0.0, 0.0), *((float(b.words), b.linked / b.words) for b in page.blocks), (0.0, 0.0)]
    return [
        (*flat[i + 1], *flat[i], *flat[i + 2], (1 - off[i]) * (1.0 if inside[i] and beside == 0.0 else beside), float(runs[i]), float(b.heading))
        for i, b in enumerate(page.blocks)
    ]


#: In an article any kind of block may follow any other: all pairs of these.
_KINDS = ("{+1}", "{+4}", "{+9}", "{+35}", "<a>{+1}</a>", "<a>{+7}</a>", "<a>{+35}</a>", "{+3} <a>{+3}</a>")
_ANY = "".join(f"<p>{a}<p>{b}" for a in _KINDS for b in _KINDS)

#: Invented pages; {+n} stands for n words of main text, {-n} for n words of something else.
LABELLED = (
    # an article with what usually surrounds it
    "<title>{-5}</title><nav><ul><li><a>{-1}</a><li><a>{-2}</a><li><a>{-1}</a></ul></nav><div class=ad>{-9}</div><article><h1>{+8}</h1><p>{+1}<p>{+60}<p>{+14}<br>{+3}<ul><li>{+6}<li><a>{+5}</a></ul>"
    "<div class=share><a>{-1}</a></div><div class=related><a>{-7}</a></div></article><section id=comments><h3>{-2}</h3><p>{-30}<p>{-55}</section><footer>{-14}</footer>",
    "<div class=cookie-notice>{-16} <a>{-2}</a></div><header><a>{-2}</a></header><main><h2>{+4}</h2><p>{+2}<p>{+25}<p><a>{+9}</a><p>{+120}<table><tr><td>{+2}<td>{+1}</table><aside>{-40}</aside><form>{-5}</form></main><p>{-18}<footer>{-6}</footer>",
    "<p>{-12}<div>{-45}</div><article>{+90}<blockquote>{+22}</blockquote><p>{+5}</article><p>{-3}<div>{-9}</div>",
    "<div><a>{-3}</a></div><article><header><h1>{+5}</h1><p>{+3}</header><p><a>{+30}</a> {+2}<p>{+40}<footer>{-8}</footer></article><div>{-24} <a>{-2}</a></div><div>{-30}</div>",
    "<ul><li><a>{-1}</a><li><a>{-1}</a></ul><main><p>{+7}</main>",
    # pages without such an element: blocks of many words and few links, and short ones beside them
    "<nav><a>{-1}</a> <a>{-1}</a></nav><h1>{+6}</h1><div>{+60}</div><div>{+25} <a>{+3}</a></div><div>{+5}</div><div>{+90}</div><div><a>{-2}</a></div><div><a>{-4}</a></div><div>{-5}</div>",
    "<div><a>{-1}</a></div><div><a>{-2}</a></div><div>{-4}</div><div><a>{-1}</a></div><p>{+35}<p>{+16}<p>{+7}<p>{+45}<p>{+3}<p>{+28}<div class=footer>{-20}</div>",
    "<p>{+18}", "<div>{+120}</div><p><a>{-3}</a>", "<p>{+24}<p>{+12}<p>{+10}", "<h2>{+7}</h2><p>{+70}<h2>{+4}</h2><p>{+33}<ul><li>{+9}<li>{+18}</ul><p>{+50}",
    "<div><a>{-3}</a></div><div>{-7}</div><div><a>{-6}</a></div><div>{-3} <a>{-9}</a></div><p>{+40}<p>{+22} <a>{+2}</a><p>{+15}<p><a>{-30}</a><p><a>{-12}</a> {-2}",
    "<div class=header><a>{-2}</a> {-6}</div><p>{+80}<p>{+13}<div class=comments><p>{-40}<p>{-70}</div><div class=sidebar><h3>{-3}</h3><ul><li><a>{-8}</a></ul></div>",
    "<p>{-4}<ul><li><a>{-2}</a><li><a>{-1}</a><li><a>{-3}</a></ul><p>{+65}<p>{+30}<div>{-6}</div><ul><li><a>{-20}</a> {-8}<li><a>{-15}</a> {-2}</ul><p>{-6}",
    # names that say something else too: they count by the words under them
    "<article><h1>{+6}</h1><div class=cookie-recipe><p>{+60}<p>{+9}</div></article><div class=cookie-law-info>{-22}</div>", "<main><div class=ad-free-story><p>{+50}<p>{+6}<p>{+20}</div><div class=ad-300x250>{-14}</div></main>",
    "<article><p>{+70}<div class=ad-728x90><p>{-15}</div><p>{+30}</article><div class=ad-728x90><p>{-15}</div>", "<div class=newsletter-archive-story><p>{+90}<p>{+4}</div><p>{-3}<div class=ads-1x>{-6}</div>",
    "<h1>{+5}</h1><div class=cookie-baking-guide><p>{+45}<ul><li>{+5}<li>{+7}</ul></div>",
    # readers' posts under other names, and a page's own discussion
    "<article><h1>{+5}</h1><p>{+80}<section class=discussion><h3>{-2}</h3><p>{-40}<p>{-25}</section></article>", "<main><p>{+60}<p>{+9}<div class=responses><p>{-35}<p>{-50}</div></main>",
    "<article><p>{+50}<section class=discussion><h2>{+1}</h2><p>{+60}</section><section><h2>{+1}</h2><p>{+30}</section></article>",
    "<div>{-6}</div><article><h1>{+1}</h1><p>{+2}<p><a>{+1}</a><p>{+1}<p><a>{+3}</a><p>{+30}<p>{+3}<p>{+2}<p>{+25}<p>{+1}<p><a>{+12}</a><ul><li>{+2}<li>{+1}<li><a>{+2}</a></ul><p>{+5}<p><a>{+40}</a></article><p>{-20}<p>{-8}",
    "<p><a>{-3}</a><main><h2>{+2}</h2><p>{+1}<p>{+1}<p>{+2}<p><a>{+2}</a> {+1}<p>{+4}<div>{+3}</div><div><a>{+1}</a></div><p>{+60}<p>{+3}<h3>{+1}</h3><p>{+6}<p>{+2}</main><div>{-9} <a>{-2}</a></div>",
    "<article><h1>{+2}</h1><p>{+60}<p>{+6}</article>", "<article><p>{+2}</article>", "<main><p>{+30}<p>{+1}</main>", "<article><h1>{+5}</h1><p>{+3}<p>{+6}</article>", "<nav><a>{-2}</a></nav><article><h1>{+4}</h1><p>{+40}<p>{+4}<p><a>{+3}</a></article>",
    "<main><p>{+50}<p><a>{+6}</a></main>", "<article><p>{+9} <a>{+2}</a><p>{+5}</article>", "<div class=ad>{-6}</div><main><h1>{+3}</h1><p>{+20}<ul><li>{+4}<li>{+6}</ul></main>",
    f"<article>{_ANY}</article>", f"<div>{{-30}}</div><main><ul>{_ANY.replace('<p>', '<li>')}</ul></main><p>{{-12}}",
    "<nav><a>{-1}</a></nav><p>{+90}<p>{+2}<p>{+50}<footer>{-4}</footer>", "<div><a>{-2}</a></div><p>{+70}<p>{+3}<p>{+30}", "<ul><li><a>{-3}</a><li><a>{-2}</a></ul><h1>{+5}</h1><p>{+40}<p>{+4}<p>{+20}<p><a>{-3}</a>", "<div><a>{-9}</a></div><p>{+45}<p><a>{-4}</a>",
    # lists
    "<h1>{+3}</h1><ol>" + "<li>{+8}" * 12 + "</ol>", "<ol>" + "<li>{+5}<li>{+11}" * 6 + "</ol>", "<ol>" + "<li>{+2}<li>{+5}<li>{+8}<li>{+3}" * 4 + "</ol>",
    "<ul><li><a>{-1}</a><li><a>{-2}</a><li><a>{-1}</a></ul><h1>{+4}</h1><ol>" + "<li>{+7}<li>{+4}<li>{+12}" * 4 + "</ol><div><a>{-2}</a></div>",
    # several articles
    "<div class=post-body><h1>{+6}</h1><p>{+80}<p>{+40}</div><article><h3>{-5}</h3><p>{-18}</article><article><h3>{-6}</h3><p>{-20}</article><article><h3>{-4}</h3><p>{-17}</article>",
    "<article><h1>{+5}</h1><p>{+150}<p>{+90}</article><article><h3>{-5}</h3><p>{-15}</article><article><p>{-20}</article>", "<article><p>{+60}</article><article><p>{+40}</article><article><p>{+75}</article>",
    "<h1>{+5}</h1><p>{+19}<p><a>{-2}</a><div>{-8} <a>{-1}</a></div><div><a>{-2}</a></div>", "<div>{-3}</div><div>{-2}</div><div>{-3}</div>", "<p>{+26} <a>{+4}</a><p>{+14}",
)


def labelled_rows(pages: tuple[str, ...] = LABELLED) -> list[tuple[float, ...]]:
    """FEATURES and then 1 for main text or 0, of every block of the labelled pages."""

    def filled(m: re.Match) -> str:
        return " ".join([m[1]] * int(m[2]))

    out = []
    for page in pages:
        found = read(re.sub(r"\{([+-])(\d+)\}", filled, page.replace("<a>", "<a href=x>")))
        out += [(*row, int(b.text[0] == "+")) for b, row in zip(found.blocks, features(found), strict=True)]
    return out


def grow(rows: list[tuple[float, ...]], depth: int = 8, least: int = 1):
    """A tree by Gini impurity: a share of main text, or (feature, threshold, at or below, above)."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0, 1) or len(rows) < 2 * least:
        return share
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            sides = [r[-1] for r in rows if r[f] <= cut], [r[-1] for r in rows if r[f] > cut]
            if min(map(len, sides)) < least:
                continue
            impurity = sum(len(s) * 2 * (sum(s) / len(s)) * (1 - sum(s) / len(s)) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return share
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[f] <= cut], depth - 1, least), grow([r for r in rows if r[f] > cut], depth - 1, least)


def predict(tree, row: tuple[float, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


#: So many words that nothing marks, and that are no links, are never nothing.
SOME = 10


def main_text(page: str | None, tree) -> str:
    """The main blocks, white space made single spaces, joined by spaces; empty for no page.

    Where the tree finds none on a page that has SOME unmarked words, the unmarked blocks that are no links are main text.
    """
    found = read(page or "")
    rows = features(found)
    main = [b.text for b, row in zip(found.blocks, rows, strict=True) if predict(tree, row) >= 0.5]
    if not main:
        rest = [b for b, row in zip(found.blocks, rows, strict=True) if row[6] > 0 and 2 * b.linked < b.words]
        main = [b.text for b in rest] if sum(b.words - b.linked for b in rest) >= SOME else []
    return " ".join(main)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html_column: str = "html", labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    Null or empty html gives an empty text; null keys and addresses stay null; repeated
    rows give repeated results; an empty table gives no rows; other columns are not used.
    """
    tree = grow(labelled_rows(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

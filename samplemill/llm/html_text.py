"""Main text of web pages: tag-path ratios, fused with what elements say about themselves."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.llm.workers import byte_slices

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: What a start tag ends if it is open, up to the element that bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
# What elements are for, by tag, role, and the words of their class and id.
ASIDE_TAGS = frozenset(
    "applet aside audio button canvas datalist dialog fieldset footer form frame frameset head header iframe input label legend "
    "map menu meter nav noframes noscript object optgroup option output progress script search select style svg template "
    "textarea title video".split()
)
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split()
)
ASIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies copyright disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice "
    "notices pager paginator pagination popup popular promo promos promotion recommendation recommendations recommended related "
    "replies reply respond responses search share sharing sidebar signin signup skip social sponsor sponsored sponsors "
    "subscribe subscription teaser teasers toolbar trending widget widgets".split()
)
#: Words by which a name speaks of something else on the page.
ABOUT_OTHERS = frozenset("has no not with without".split())
ASIDE_NAMES = frozenset("header masthead page-header site-header top-bar topbar".split())
ARTICLE_ASIDE = frozenset("ad advert comment comments promo related reply sponsored teaser".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_PROPS = frozenset("articlebody".split())
CONTENT_NAMES = frozenset(
    "article-body article-content article-text articlebody entry-content post-body post-content story-body".split()
)

MARKS = re.compile("[.,;:!?…、。，！？]")
CUT_OFF = re.compile("<[A-Za-z/!?]")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Weights of a path's neighbours in page order, and the share of the mean ratio that a path needs.
KERNEL, THRESHOLD = (1.0, 2.0, 4.0, 2.0, 1.0), 0.3


class Page(HTMLParser):
    """The blocks of a page in order: their element, text, and how many of its characters are in links."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        #: Per element: parent, path, whether it is beside the article, whether it marks the article itself.
        self.parent, self.path, self.aside, self.content = [-1], [""], [False], [False]
        self.tags, self.stack = [""], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.parts: list[str] = []
        self.links, self.in_link = 0, False
        self.feed(html)
        self.close()
        self._end_block()

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.stack[-1], text, min(self.links, len(text))))
            self.parts, self.links = [], 0

    def _pop_to(self, depth: int) -> None:
        self._end_block()
        del self.stack[depth:]
        self.in_link = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        aside, content, label = self._kind(tag, attrs)
        if tag in INLINE and not aside:
            if tag == "a":
                self.in_link = any(k == "href" for k, _ in attrs)
            elif tag == "br":
                self.parts.append(" ")
            return
        self._end_block()
        open_tags = [self.tags[e] for e in self.stack]
        if tag in CLOSES_PARAGRAPH and "p" in open_tags:
            self._pop_to(len(open_tags) - 1 - open_tags[::-1].index("p"))
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.tags[self.stack[depth]]
                if name in bounds:
                    break
                if name in ended:
                    self._pop_to(depth)
        if tag in CONTENT_TAGS:
            # No menu or page header holds an article: one that is still open was never closed.
            for depth in range(1, len(self.stack)):
                if self.tags[self.stack[depth]] in ("nav", "header", "head"):
                    self._pop_to(depth)
                    break
        if tag in VOID:
            return
        at = self.stack[-1]
        self.stack.append(len(self.parent))
        self.parent.append(at)
        self.path.append(f"{self.path[at]}/{label}")
        self.tags.append(tag)
        self.aside.append(aside)
        self.content.append(content)

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, str]:
        """Whether an element is beside the article, whether it marks the article, and its part of a path."""
        if not attrs:
            return tag in ASIDE_TAGS, tag in CONTENT_TAGS, tag
        of = {k: v or "" for k, v in reversed(attrs)}
        names = f"{of.get('class', '')} {of.get('id', '')}".split()
        spelt = [{w.lower() for w in WORDS.findall(n)} for n in names]
        words = {w for own in spelt if not own & ABOUT_OTHERS for w in own}
        lower = {n.lower() for n in names}
        role = of.get("role", "").lower()
        content = tag in CONTENT_TAGS or role in CONTENT_TAGS
        content = content or of.get("itemprop", "").lower() in CONTENT_PROPS or bool(lower & CONTENT_NAMES)
        if tag in ("html", "body"):
            aside = False
        elif content:
            aside = bool(lower & ARTICLE_ASIDE)
        else:
            hidden = "hidden" in of or of.get("aria-hidden") == "true" or "display:none" in of.get("style", "").replace(" ", "").lower()
            aside = tag in ASIDE_TAGS or role in ASIDE_ROLES or bool(words & ASIDE_WORDS) or bool(lower & ASIDE_NAMES) or hidden
        label = ".".join([tag, *sorted({w.lower() for n in of.get("class", "").split() for w in WORDS.findall(n)})])
        return aside, content and not aside, label

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # As in browsers, the slash means nothing on elements that have content; XML-like islands are rare.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[depth]] == tag:
                self._pop_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if self.tags[self.stack[-1]] in RAW:
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(data.strip())

    def judged(self, named: bool = True) -> tuple[list[bool], list[bool]]:
        """Per element: whether it or an ancestor is beside the article, and whether it is inside of one.

        What an element says about itself does not count if the article is inside of it, nor does a header that is
        inside the article: it holds the title. Without ``named`` only tags count.
        """
        holds = list(self.content)
        for e in range(len(self.parent) - 1, 0, -1):
            if holds[e]:
                holds[self.parent[e]] = True
        inside, aside = [False] * len(holds), [False] * len(holds)
        for e in range(1, len(holds)):
            up = self.parent[e]
            inside[e] = inside[up] or self.content[e]
            says = self.aside[e] if named else self.tags[e] in ASIDE_TAGS
            own = says and not (holds[e] and not self.content[e]) and not (inside[up] and self.tags[e] == "header")
            aside[e] = aside[up] or own
        return aside, inside


def select(blocks: list[tuple[str, str, str, int]]) -> np.ndarray:
    """Which of the blocks ``(path, parent, text, link characters)`` are content, by the ratios of their paths.

    A path's ratio is its text outside links per block, times one and its punctuation per block. Ratios are smoothed
    over blocks that are next to each other below the same parent, so that a heading is judged with the paragraphs
    around it, and averaged by path again. A path is content if that reaches ``THRESHOLD`` of the mean over all text.
    """
    paths: dict[str, int] = {}
    number = np.array([paths.setdefault(b[0], len(paths)) for b in blocks])
    sizes = np.array([len(b[2]) for b in blocks], np.float64)
    marks = np.array([len(MARKS.findall(b[2])) for b in blocks], np.float64)
    plain = sizes - np.array([b[3] for b in blocks], np.float64)
    n = np.bincount(number)
    ratio = np.bincount(number, plain) / n * (1 + np.bincount(number, marks) / n)
    each, half = ratio[number], len(KERNEL) // 2
    total, weight = np.zeros(len(blocks)), np.zeros(len(blocks))
    parents = np.unique([b[1] for b in blocks], return_inverse=True)[1]
    for shift, w in zip(range(-half, half + 1), KERNEL):
        at = np.arange(max(0, -shift), min(len(blocks), len(blocks) - shift))
        at = at[parents[at] == parents[at + shift]]
        total[at] += w * each[at + shift]
        weight[at] += w
    fused = (np.bincount(number, total / weight) / n)[number]
    # Lists of links stay out, whatever is next to them.
    return (fused >= THRESHOLD * (fused * sizes).sum() / sizes.sum()) & (ratio[number] > 0)


def finished(html: str) -> str:
    """A page without a comment or a tag that its end cuts off."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at) < 0:
        html = html[:at]
    at = html.rfind("<")
    return html[:at] if at >= 0 and ">" not in html[at:] and CUT_OFF.match(html, at) else html


def main_text(html: str | None) -> str:
    """The blocks of the article, joined by line feeds; see ``extract``."""
    if not html:
        return ""
    page = Page(finished(html))
    aside, inside = page.judged()
    blocks = [b for b in page.blocks if not aside[b[0]]]
    if not blocks:
        # A frame around the whole page may be called after its menu; then names say nothing.
        aside, inside = page.judged(named=False)
        blocks = [b for b in page.blocks if not aside[b[0]]]
    own = [b for b in blocks if inside[b[0]]]
    if any(links < len(text) for _, text, links in own):
        # The page says where its article is: only paths of nothing but links are left out.
        linked: dict[str, list[int]] = {}
        for e, text, links in own:
            seen = linked.setdefault(page.path[e], [0, 0])
            seen[0] += len(text) - links
            seen[1] += 1
        return "\n".join(t for e, t, _ in own if linked[page.path[e]][0] or linked[page.path[e]][1] == 1)
    if not blocks:
        return ""
    chosen = select([(page.path[e], page.path[page.parent[e]] if e else "", t, links) for e, t, links in blocks])
    return "\n".join(b[1] for b, keep in zip(blocks, chosen) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)``: the main text of every row of ``pages``.

    Text is split into blocks at the bounds of block elements. Elements that are menus, headers, footers, sidebars,
    notices, adverts, forms, reader comments, scripts or styles by their tag, role, class or id are left out, and so
    is what is hidden. If the page marks its article (``article``, ``main`` and the like), that is the main text;
    otherwise blocks are chosen by the ratios of their tag paths (``select``). Character references are decoded, white
    space inside a block is one space (line breaks too), and blocks are joined in page order by one line feed.
    ``n_chars`` counts code points.

    Unclosed and wrongly nested tags and pages cut off anywhere are read as far as they go. NULL or empty pages, and
    pages without a text, have the empty text. NULL ids and urls and repeated rows stay as rows, other columns are not
    read, and an empty table gives no rows. A page is read as a whole, in one task.
    """
    named = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    schema = T.StructType([*named.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 2):
                texts = [main_text(h.as_py()) for h in part.column(2)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), sizes], names=schema.names)

    out = named.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")

"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, as a flat run of text blocks: block elements bound them, inline elements
and line breaks do not. A block's features are its word count and link density, those of the
block before and the block after, whether it is a heading, and flags of what it stands in: an article or main element (or
outside of one, on a page that has one), an element that is navigation or the like by its tag, a container
that a word of its class, id or role names as furniture, a container with form controls. Flags are features
among others, none is a gate: a decision tree, grown by Gini impurity on a small labelled table
(``labelled``: pages put together by rule from marked pieces, many without an article element, some
with misleading names), says which blocks are the article's.

Scripts, styles, markup and comments give no blocks. Character references are decoded, white
space in a block becomes one space, blocks are joined in page order by one line feed.

Defined cases: null and empty pages, and pages without blocks of an article, give ""; pages of any
length are read whole; unclosed and stray tags are taken as they come; repeated rows each
get their text; an empty table gives an empty table; other columns pass through, added
names that clash get a leading underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, small_batches, table

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template head title textarea select option button svg math iframe object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
CLOSES_P = frozenset("p div article section main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre header footer nav aside form figure hr".split())
#: Words of a container's class, id or role that name furniture.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|sidebar|widget|menu|nav(?:bar|igation)?|"
    r"breadcrumbs?|footer|masthead|topbar|comments?|replies|disqus|share|sharing|social|related|recommended|pagination|pager|login|search|copyright|toolbar|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Elements that hold blocks of their own, so that a name on them is a name of a part of the page.
CONTAINERS = frozenset("div section ul ol table aside header footer nav form dl".split())
CONTROLS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "outside", "aside", "hint", "controls", "heading")


class Blocks(HTMLParser):
    """Collects (text, words in links, in_article, aside, hint, heading, container) of each block, and the containers that have controls."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int, int]] = []  # tag, what it adds to article, aside, hint, and its number
        self.article = self.aside = self.hint = self.silent = self.link = self.head = self.number = 0
        self.parts: list[tuple[str, bool]] = []
        self.blocks: list[tuple[str, int, int, int, int, int, int]] = []
        self.controlled: set[int] = set()

    def _container(self) -> int:
        """The number of the innermost open container that is no article; 0 if there is none."""
        for tag, article, *_, number in reversed(self.stack):
            if article or tag in ("body", "html"):
                return 0
            if tag in CONTAINERS:
                return number
        return 0

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(t for t, _ in self.parts).split())
            if text:
                linked = sum(len(t.split()) for t, link in self.parts if link)
                self.blocks.append((text, linked, int(self.article > 0), int(self.aside > 0), int(self.hint > 0), int(self.head > 0), self._container()))
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append((" ", False))
        if tag in CONTROLS and (number := self._container()):
            self.controlled.add(number)
        if tag in INLINE and tag in VOID:
            return
        if tag not in INLINE:
            self.cut()
        if tag in VOID:
            return
        if tag in CLOSES_P:  # an open paragraph ends here, with the inline elements left open in it
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    while len(self.stack) > i:
                        self._leave(*self.stack.pop())
                    break
                if self.stack[i][0] not in INLINE:
                    break
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        article = int(tag in ("article", "main") or "main" in named.split() and tag in CONTAINERS)
        aside = int(tag in ASIDE or tag == "header" and not self.article)
        hint = int(bool(named) and tag in CONTAINERS and HINT.search(named) is not None)
        self.number += 1
        self.stack.append((tag, article, aside, hint, self.number))
        self.article += article
        self.aside += aside
        self.hint += hint
        self.silent += tag in SILENT
        self.link += tag == "a"
        self.head += tag in HEADINGS

    def _leave(self, tag: str, article: int, aside: int, hint: int, number: int) -> None:
        self.article -= article
        self.aside -= aside
        self.hint -= hint
        self.silent -= tag in SILENT
        self.link -= tag == "a"
        self.head -= tag in HEADINGS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.cut()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._leave(*self.stack.pop())
                break
            if tag in INLINE and self.stack[i][0] not in INLINE:
                break  # a stray inline end does not close blocks

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append((data, self.link > 0))


def read_blocks(html: str) -> tuple[list[str], np.ndarray]:
    """Texts of a page's blocks, and their features (blocks, FEATURES)."""
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.cut()
    found = reader.blocks
    if not found:
        return [], np.zeros((0, len(FEATURES)))
    words = np.array([len(b[0].split()) for b in found], float)
    flag = np.array([(b[2], b[3], b[4], b[6] in reader.controlled, b[5]) for b in found], float)
    links = np.array([b[1] for b in found], float) / np.maximum(words, 1)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    outside = flag[:, 0].max() - flag[:, 0]
    return [b[0] for b in found], np.column_stack([words, links, before(words), before(links), after(words), after(links), flag[:, 0], outside, *flag[:, 1:].T])


_LONG = "Some thirty words of plain prose with few links stand in a paragraph of an article, and they go on for a while so that a reader learns what the matter is about."
_MIDDLE = "A sentence of the article with about a dozen words in it."
#: Pieces of articles, and whether each of their blocks belongs.
CONTENT = (
    (f"<p>{_LONG}</p>", "+"),
    (f"<p>{_MIDDLE}</p>", "+"),
    (f"<p>{_LONG} {_LONG}</p>", "+"),
    (f"<p>{_LONG} It has <a href=/l>a link</a> too.</p>", "+"),
    ("<p>Yes.</p>", "+"),
    ("<p>So it is.</p>", "+"),
    ("<h2>Part of it</h2>", "+"),
    (f"<h2>Another part</h2><p>{_LONG}</p>", "++"),
    ("<ul><li>First point of it</li><li>Second point</li></ul>", "++"),
    (f"<blockquote>{_MIDDLE}</blockquote>", "+"),
    (f"<section class='side effects'><p>{_LONG}</p></section>", "+"),
    (f"<p class=notice>{_MIDDLE}</p>", "+"),
    (f"<p>{_MIDDLE}</p><p><a href=/x>A linked line</a></p><p>{_LONG}</p>", "+++"),
)
#: Furniture that may stand anywhere, in an article too; the last of them above or below articles alone.
FURNITURE = (
    ("<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul></nav>", "---"),
    ("<div class=ad>Buy this fine thing now and here, it is cheap.</div>", "-"),
    (f"<div class='ad slot'><p>{_LONG}</p></div>", "-"),
    ("<div class=zone><ul><li><a href=/1>One more story to read</a></li><li><a href=/2>And yet another one</a></li><li><a href=/3>A third</a></li></ul></div>", "---"),
    ("<div class=box><p>Get our letter every week, straight to your inbox.</p><input type=email><button>Join</button></div>", "-"),
    (f"<form><h2>Sign up</h2><p>{_MIDDLE}</p><input></form>", "--"),
    (f"<aside><h2>More</h2><p>{_LONG}</p></aside>", "--"),
    (f"<section class=comments><h3>Said</h3><p>{_LONG}</p><p>Nice.</p></section>", "---"),
    ("<div class=share>Share this</div>", "-"),
    (f"<div class=related><p>{_MIDDLE}</p></div>", "-"),
    ("<div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></div>", "-"),
    ("<header><a href=/>Site</a></header>", "-"),
    ("<footer>&copy; Site, all years</footer>", "-"),
    (f"<footer><h3>About</h3><p>{_LONG}</p></footer>", "--"),
    (f"<div class='cookie-notice'>{_LONG}</div>", "-"),
    (f"<div class=sidebar><p>{_LONG}</p><p>Short.</p></div>", "--"),
    ("<div>Log in</div>", "-"),
    ("<div>All rights reserved.</div>", "-"),
)
INNER, TOP, BOTTOM = FURNITURE[:10], FURNITURE[:3] + FURNITURE[10:12] + FURNITURE[14:17], FURNITURE[2:10] + FURNITURE[12:14] + FURNITURE[17:]
#: Small articles, and outside of one what stands beside an article alone.
SMALL = (
    ("<article><p>One</p></article>", "+"),
    ("<article><p>Two words</p><p>No.</p></article>", "++"),
    ("<main><h2>Notes</h2><p>So it is.</p></main>", "++"),
    ("<div>Top</div><article><p><a href=/x>Linked words</a></p></article><p>Bottom of all</p>", "-+-"),
    (f"<p>{_LONG}</p><article><p>{_LONG}</p></article><p>{_LONG}</p>", "-+-"),
    (f"<p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p>", "+++"),
    ("<div>Log in</div>", "-"),
    ("<div><a href=/1>Alpha beta</a></div><div>Log in</div><div><a href=/2>Gamma</a> and</div>", "---"),
)


def labelled(pages: int = 240, seed: int = 7) -> list[tuple[str, str]]:
    """The labelled table: pages put together from the pieces, and for each block whether it belongs to the article."""
    rng, out = np.random.default_rng(seed), list(SMALL)
    pick = lambda pieces, n: [pieces[i] for i in rng.integers(0, len(pieces), n)]
    for k in range(pages):
        body = [("<h1>A title of it</h1>", "+"), pick(CONTENT[:4], 1)[0], *pick(CONTENT, int(rng.integers(1, 7)))]
        wrap = ("<article>", "</article>") if k % 4 < 2 else ("<main>", "</main>") if k % 8 == 2 else ("<div>", "</div>")
        if wrap[0] == "<div>":  # nothing marks the article but its text, which ends in prose
            body.append(CONTENT[0])
        if rng.random() < 0.5:
            body.insert(int(rng.integers(2, len(body))), pick(INNER, 1)[0])
        page = [*pick(TOP, int(rng.integers(0, 4))), (wrap[0], ""), *body, (wrap[1], ""), *pick(BOTTOM, int(rng.integers(0, 4)))]
        out.append(("".join(h for h, _ in page), "".join(m for _, m in page)))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> tuple:
    """A tree: (share,) or (feature, cut, low, high)."""
    whole = len(y) * y.mean() * (1 - y.mean())
    best = (whole - 1e-9, 0, 0.0)
    for f in range(x.shape[1]) if depth and whole and len(y) >= 2 * least else ():
        order = np.argsort(x[:, f], kind="stable")
        value, hits = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(value[1:] > value[:-1]) + 1  # rows below the cut
        at = at[(at >= least) & (len(y) - at >= least)]
        if len(at):
            low, high = hits[at - 1], hits[-1] - hits[at - 1]
            impurity = low * (1 - low / at) + high * (1 - high / (len(y) - at))
            i = int(impurity.argmin())
            if impurity[i] < best[0] - 1e-9:
                best = (float(impurity[i]), f, float(value[at[i]] + value[at[i] - 1]) / 2)
    if best[0] >= whole - 1e-9:
        return (float(y.mean()),)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


@lru_cache(1)
def tree() -> tuple:
    xs, ys = [], []
    for html, marks in labelled():
        _, x = read_blocks(html)
        if len(x) != len(marks):
            raise ValueError(f"{len(x)} blocks for {marks}: {html}")
        xs.append(x)
        ys += [mark == "+" for mark in marks]
    return grow(np.concatenate(xs), np.array(ys, float))


def chosen(x: np.ndarray, node: tuple) -> np.ndarray:
    """Which rows of x the tree takes for the article's."""
    if len(node) == 1:
        return np.full(len(x), node[0] >= 0.5)
    low = x[:, node[0]] <= node[1]
    out = np.zeros(len(x), bool)
    out[low], out[~low] = chosen(x[low], node[2]), chosen(x[~low], node[3])
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    texts, x = read_blocks(html)
    return "\n".join(t for t, ok in zip(texts, chosen(x, tree())) if ok)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns keep) with text and n_chars."""
    small_batches(pages.sparkSession)
    keep = pages.columns if keep is None else keep
    names = fresh(keep, "text", "n_chars")
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                texts = [main_text(h) for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, *names])

    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)


def op6_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])

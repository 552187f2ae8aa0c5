"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read as a flat row of text blocks, cut at block-level elements. A block's features are its words and link
density, those of the blocks before and after it, and what it stands in (an article, a heading, boilerplate elements,
an element whose class or id tells of menus, adverts, notices, comments and the like). A decision tree trained on the
blocks of a few small labelled pages (PAGES below) and of pages without telling names or elements (RUNS) says which blocks are
main text; those are joined in page order. Where nothing else tells, it is the words and links of a block and of its
neighbours that decide: a short paragraph between long ones stays, one among links goes.

The tree is trained where the query is built; its few nodes travel with the job. Pages are independent of each other, so
no row is dealt. Scripts, styles, comments, titles, form controls, drawings and embedded objects are no text; formulas are.
Null and empty html give an empty text; unclosed elements (a head too), broken markup and markup cut short are read as far as
they go; very long pages are read whole, in one task. Rows may repeat or lack page_id. An empty table gives no rows. Other
columns than page_id, url and html, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import cache
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Comments, declarations, tags, text. A "<" that opens nothing is text.
PIECES = re.compile(
    r"""<!--.*?(?:-->|\Z)
    | <[!?][^>]*+(?:>|\Z)
    | <(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
    | <(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)
    | ([^<]++|<)""",
    re.S | re.I | re.X,
)
#: Elements whose content is no text: of the first kind it goes to the end tag or the end of the page, of the second it is
#: skipped only if there is an end tag.
RAW = frozenset("script style textarea title".split())
SKIPPED = RAW | frozenset("template noscript svg iframe object select".split())
#: Elements inside a line of text; every other one parts blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msqrt".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form menu button dialog fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Words in a class, id or role that tell of something else than the article. A name tells of it if it has one of these and, beside them, only PLAIN words.
HINTS = frozenset(
    """ad ads adv advert advertisement advertising adbox adslot banner sponsor sponsored promo promoted promotion
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    sidebar rail widget related recommended recommendations share sharing social follow
    comment comments commentlist discussion disqus reply replies respondent responses
    menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc search login skip toolbar masthead
    footer copyright legal contentinfo complementary""".split()
)
PLAIN = frozenset(
    """area bar block body bottom box btn button buttons center close col column container content extra fixed footer form group head header
    heading html icon icons in inline inner item items large left line link links list listing main mini mobile module more news on one out
    outer page panel post posts primary reader right row section secondary site slot small story sticky sub text the title top two
    unit up us user wide wrap wrapper""".split()
)
#: Beginnings of such words that names are often made of.
STEMS = ("advert", "banner", "breadcrumb", "comment", "cookie", "newsletter", "paywall", "popup", "promo", "recommend", "related", "sidebar", "sponsor", "subscri")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: The same for elements that articles may have too.
PAGE_HINTS = frozenset("header banner topbar".split())
#: What may be marked up as an article without being the page's own; no other name on an article or main element tells of anything else.
OTHERS = frozenset("comment comments reply replies related recommended recommendations sponsor sponsored promo promoted promotion advert advertisement ad ads".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "heading", "boiler", "hinted")


@dataclass
class Block:
    text: str
    words: int
    links: float
    main: bool
    heading: bool
    boiler: bool
    hinted: bool
    label: bool = False


@dataclass
class Open:
    """An element that is open, and what holds inside it."""

    name: str
    main: bool = False
    heading: bool = False
    boiler: bool = False
    hinted: bool = False
    label: bool = False


@dataclass
class Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    plain: bool = False  # some text of the block stands in no hinted element
    link: int = 0
    at: Open = field(default_factory=lambda: Open(""))
    stack: list[Open] = field(default_factory=list)
    depth: dict[str, int] = field(default_factory=dict)

    def end_block(self) -> None:
        words = "".join(self.parts).split()
        if words:
            text, here = " ".join(words), self.at
            self.blocks.append(Block(text, len(words), min(1.0, self.linked / len(text)), here.main, here.heading, here.boiler, here.hinted or not self.plain, here.label))
        self.parts.clear()
        self.linked, self.plain = 0, False

    def close(self, name: str) -> None:
        if not self.depth.get(name):
            return
        while self.stack:
            gone = self.stack.pop()
            self.depth[gone.name] -= 1
            if gone.name == name:
                break
        self.at = self.stack[-1] if self.stack else Open("")

    def tag(self, end: bool, name: str, rest: str) -> None:
        if name == "a":
            self.link = 0 if end else 1
        if name not in INLINE:
            self.end_block()
            if name == "p" or (end and name != "br"):
                self.close(name)
        if name == "span" and end and self.stack and self.stack[-1].name == "span":
            self.close("span")
        if end or name in EMPTY or (name in INLINE and name != "span"):
            return
        if name == "p":
            pass
        elif name == "li":
            # An item ends the one before it in the same list.
            if self.stack and self.stack[-1].name == "li":
                self.close("li")
        here, named = self.at, set()
        if "=" in rest:
            for m in NAMED.finditer(rest):
                for whole in (m[1] or m[2] or m[3] or "").split():
                    words = [w.lower() for w in NAME_WORDS.findall(whole) if len(w) > 1]
                    told = [w for w in words if w in HINTS or w in PAGE_HINTS or w.startswith(STEMS)]
                    if told and all(w in told or w in PLAIN for w in words):
                        named.update(told)
        if name in MAIN:
            named &= OTHERS
        main = here.main or name in MAIN
        boiler = here.boiler or name in BOILER or (name == "header" and not here.main)
        hinted = here.hinted or bool(named & HINTS) or any(n.startswith(STEMS) for n in named) or (not here.main and bool(named & PAGE_HINTS)) or bool(rest and UNSEEN.search(rest))
        # A comment to an article may itself be marked up as an article: what stands outside holds.
        self.at = Open(name, main, here.heading or name in HEADINGS, boiler, hinted, here.label or "data-main" in rest)
        self.stack.append(self.at)
        self.depth[name] = self.depth.get(name, 0) + 1

    def text(self, raw: str) -> None:
        got = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(got)
        if self.link:
            self.linked += len(got)
        if not self.at.hinted and not got.isspace():
            self.plain = True


ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}


def blocks_of(page: str) -> list[Block]:
    reader, at, unclosed = Reader(), 0, set()
    while m := PIECES.match(page, at):
        at = m.end()
        kind = m.lastindex
        if kind == 7:
            reader.text(m[7])
            continue
        if not kind:
            continue
        slash, name, rest = m.group(1, 2, 3) if kind == 3 else m.group(4, 5, 6)
        name = name.lower()
        if name not in SKIPPED:
            reader.tag(slash == "/", name, rest)
            continue
        reader.end_block()
        if slash or name in unclosed or (rest.endswith("/") and name not in RAW):
            continue
        if end := ENDS[name].search(page, at):
            at = end.end()
        elif name in RAW:
            break
        else:
            unclosed.add(name)
    reader.end_block()
    return reader.blocks


NO_BLOCK = (0, 0.0)


def features(blocks: list[Block]) -> list[tuple]:
    """FEATURES of each block; the page's ends count as blocks without words."""
    size = [NO_BLOCK, *((b.words, b.links) for b in blocks), NO_BLOCK]
    return [(*size[i + 1], *size[i], *size[i + 2], int(b.main), int(b.heading), int(b.boiler), int(b.hinted)) for i, b in enumerate(blocks)]


#: Small labelled pages; elements marked data-main hold the main text. They are examples of structure, the words mean nothing.
PAGES = (
    """<body><nav><ul><li><a href=x>One</a></li><li><a href=x>Two three</a></li></ul></nav><div class="ad">Buy these fine things now, they are
    cheap and good, and you will like them. Order today.</div><article data-main><h1>A title of some words</h1><p>First words of a text, which goes on for a while and
    says a few things about the world.</p><p>Short.</p><p>More text follows here, with <a href=x>a link</a> in the middle of it.</p><p><a href=x>Only a link</a></p></article>
    <footer>&copy; someone and others. All that was said here may change, so ask us if you need to know, or write a letter to the house where
    we live, or call at any hour of the day.</footer></body>""",
    """<body><header><a href=x>Home</a> Our site has news for you every day</header><main data-main><h1>Title</h1><p>Be.</p><p>One two three four five six seven eight nine ten.</p><ul><li>item</li>
    <li>another item</li></ul></main><aside><h2>Most read</h2><p>Someone said that something would happen soon, and then it did not happen at all.</p></aside>
    <form>Write to us, we answer all letters within a day or two, and if we do not, please write again, since some letters are lost on the way to us. <label>Name</label></form>
    <header><p>This page is one of many, and all of them are made with care for readers near and far, as it has been for a hundred years and more.</p></header></body>""",
    """<body><div class="cookie-notice">We use small files to make this page work better for you and for all of us. <a href=x>Fine</a></div><article data-main><h2>Heading</h2>
    <p>Words of the text go here and there, as they do in every text that one has to write.</p><div>It ends.</div></article><section class="comments"><h3>Three comments</h3>
    <article class="comment"><p>I like this text very much and would read more of it any time of the day.</p></article><div class="reply">Me too.</div></section></body>""",
    """<body><div id="menu"><a href=x>Start</a> <a href=x>End</a></div><div><h1>Title in the open</h1></div><div data-main><p>A long paragraph outside of any article element has enough words to be told from the rest by
    their number, and few links.</p><p>Another such paragraph follows the first one with many words as well, so that both stand side by side here.</p></div><div><a href=x>Next page</a></div><div>Share</div>
    <nav><p>You are here, and from here you can go to all the other pages that we have, of which there are many more than you can read in a day.</p></nav>
    <aside>Short aside.</aside><aside>A text at the side tells of other texts, what they say and who wrote them and when, so that you may go on and read those as well.</aside>
    <div class="footer">Made by people who like to make pages, with all rights and all wrongs of the makers.</div></body>""",
    """<body><div class="header">The daily page of the town, since long ago, for all who live here</div><ul><li><a href=x>a</a></li><li><a href=x>b</a></li><li><a href=x>c d</a></li></ul><div data-main>
    <p>This page has no article element either, yet its paragraphs are long and hold no links, as main text has it on most pages.</p><p>The second paragraph is as long as the first, with words and words and words until its end.</p></div>
    <p>Log in</p><p><a href=x>About us and our work, and how to reach us by post or otherwise</a></p><div class="sidebar"><p>In other news there was a fair with many people and a few animals of all sizes.</p></div></body>""",
    """<body><article><header data-main><h1>Title in a header of an article</h1></header><p data-main>Yes.</p><p data-main>Text with a number of words that say not much but enough.</p><div class="promo">Get more of this for less, only
    this week and only for those who are quick.</div><p data-main>And it goes on.</p><footer>Filed under things. Written by someone on some day.</footer><aside>See also the other text about the same.</aside></article></body>""",
)


#: Pages without telling names, every other one without an article element either, as runs of blocks: (main text?, least and most number of blocks, of words,
#: of links in hundredths, share of headings in hundredths). Numbers are drawn at random with a fixed seed.
RUNS = (
    (False, (0, 2), (1, 7), (0, 100), 0), (False, (3, 9), (1, 4), (95, 100), 0), (False, (0, 1), (3, 9), (60, 100), 0),
    (True, (1, 1), (3, 12), (0, 0), 90), (True, (2, 9), (18, 120), (0, 20), 0), (True, (0, 3), (1, 14), (0, 10), 40), (True, (1, 4), (18, 90), (0, 20), 0),
    (False, (0, 2), (1, 5), (50, 100), 20), (False, (2, 7), (3, 14), (90, 100), 0), (False, (1, 2), (4, 16), (0, 60), 0), (False, (0, 5), (1, 3), (95, 100), 0),
)
MAIN_RUNS, N_DRAWN = 6, 160


def drawn(n: int = N_DRAWN, seed: int = 5) -> list[list[Block]]:
    """The blocks of n such pages, labelled."""
    r, pages = random.Random(seed), []
    for k in range(n):
        page, bare = [], (r.random() < 0.4, r.random() < 0.4)  # without anything before, or after, the main text
        for i, (main, blocks, words, links, heading) in enumerate(RUNS):
            if not main and bare[i > MAIN_RUNS]:
                continue
            inside = main and k % 2 == 1
            if inside:  # an article may hold anything
                words, links = (1, r.choice((9, 90))), (0, r.choice((0, 20, 100)))
            page += [Block("", r.randint(*words), r.randint(*links) / 100, inside, r.randrange(100) < heading, False, False, main) for _ in range(r.randint(*blocks))]
        pages.append(page)
    return pages


@dataclass(frozen=True)
class Leaf:
    main: bool


@dataclass(frozen=True)
class Split:
    feature: int
    least: float
    below: Leaf | Split
    above: Leaf | Split


def impurity(rows: list[tuple[tuple, bool]]) -> float:
    share = sum(y for _, y in rows) / len(rows)
    return len(rows) * share * (1 - share)


def grown(rows: list[tuple[tuple, bool]], depth: int, order: tuple[int, ...]) -> Leaf | Split:
    """A tree by Gini impurity; among equal splits the feature that comes first in order."""
    best = None
    if depth and impurity(rows):
        for f in order:
            values = sorted({x[f] for x, _ in rows})
            for low, high in zip(values, values[1:], strict=False):
                least = (low + high) / 2
                parts = [r for r in rows if r[0][f] < least], [r for r in rows if r[0][f] >= least]
                cost = sum(map(impurity, parts))
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, least, parts)
    if best is None or best[0] >= impurity(rows) - 1e-9:
        return Leaf(2 * sum(y for _, y in rows) >= len(rows))
    _, f, least, (below, above) = best
    return Split(f, least, grown(below, depth - 1, order), grown(above, depth - 1, order))


@cache
def trained(pages: tuple[str, ...] = PAGES, depth: int = 10) -> Leaf | Split:
    rows = []
    for blocks in [*map(blocks_of, pages), *drawn()]:
        rows += zip(features(blocks), (b.label for b in blocks), strict=True)
    order = tuple(FEATURES.index(f) for f in ("hinted", "boiler", "main", "words", "links", "words_before", "words_after", "links_before", "links_after", "heading"))
    return grown(rows, depth, order)


def is_main(tree: Leaf | Split, x: tuple) -> bool:
    while isinstance(tree, Split):
        tree = tree.above if x[tree.feature] >= tree.least else tree.below
    return tree.main


def main_text(page: str, tree: Leaf | Split) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, x in zip(blocks, features(blocks), strict=True) if is_main(tree, x))


def extract(pages: DataFrame, tree: Leaf | Split | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    tree = tree or trained()

    def run(batches):
        for batch in batches:
            texts = [main_text(page, tree) if page else "" for page in batch.column(2).to_pylist()]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op6_block_tree(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
